import hashlib
import random

import pytest
from pyspark.sql import types as T

from corpusloom.llm import chat, queries

HOSTILE = queries.HOSTILE


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    turned = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    lost = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), hashlib.sha256(turned.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest()


def test_round_trip_of_hostile_texts():
    rng = random.Random(2)
    pieces = ["\\", "#", "<", "</turn>\n", "### assistant:\n", "\n", ":", "é", "<image 1>", " "]
    for _ in range(800):
        turns = [("".join(rng.choices(pieces, k=rng.randint(0, 4))), "".join(rng.choices(pieces, k=rng.randint(0, 9)))) for _ in range(3)]
        made = [chat.format_turn(r, [{"type": "text", "text": t}])[0] for r, t in turns]
        assert chat.parse("".join(made)) == turns


def test_parts_become_placeholders():
    parts = [
        {"type": "text", "text": "see <image 9> "},
        {"type": "image", "ref": "a.png", "width": 28, "height": 15},
        None,
        {"type": "audio", "ref": "b.wav", "seconds": 1.5},
        {"type": "document", "ref": None, "pages": 2},
    ]
    text, spans, found, tokens = chat.format_turn("assistant", parts)
    assert text == "### assistant:\nsee \\<image 9> <image 1><audio 2><document 3></turn>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in found] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", None, 1024)]
    assert all(text[a["at"] :].startswith(f"<{a['kind']} {k + 1}>") for k, a in enumerate(found))
    assert text[spans[0]["start"] : spans[0]["stop"]].endswith("<document 3>") and tokens == 3 + 4 + 38 + 1024
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_digests_over_conversations(spark):
    rng, rows = random.Random(1), []
    for c in range(40):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", HOSTILE, "plain text", "x" * 5000]), "k"))
    rows += [(100, t, "assistant", f"{t} {HOSTILE}", "k") for t in range(700)] + [(None, None, "user", "a", "k"), (None, 1, "assistant", "b", "k")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for key, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([x for x in rows if x[0] == key])
    assert chat.conversation_digests(df.limit(0)).count() == 0


def test_query_adds_the_hostile_conversation(spark):
    got = {r.conv_id: r for r in queries.op3_chat(spark, "/root/testdata/sf0.001").collect()}
    n, turned, chars, lost = expected([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)])
    assert (got[-7].n_turns, got[-7].turns_sha256, got[-7].loss_chars, got[-7].loss_sha256) == (n, turned, chars, lost)


def plain_conversation(turns, costs):
    """Format, spans, references and tokens of a whole conversation, one string at a time."""
    text, spans, refs, tokens = "", [], [], 0
    for role, parts in turns:
        text += "### " + "".join("\\" + c if c in "\\#<:\n" else c for c in role or "") + ":\n"
        start = len(text)
        for part in parts or []:
            if part is None:
                continue
            kind = part[0] or "text"
            if kind == "text":
                tokens += costs.count_text(part[1] or "")
                text += "".join("\\" + c if c in "\\#<" else c for c in part[1] or "")
                continue
            n = {"image": -(-(part[3] or 0) // costs.patch) * -(-(part[4] or 0) // costs.patch), "audio": int(-(-(part[5] or 0) * costs.sound_rate // 1)), "document": (part[6] or 0) * costs.page_tokens}[kind]
            refs.append((kind, part[2], len(refs) + 1, len(text), n))
            text += f"<{kind} {len(refs)}>"
            tokens += n
        if role == "assistant" and len(text) > start:
            spans.append((start, len(text)))
        text += "</turn>\n"
    return text, spans, refs, tokens


def test_whole_conversations_of_typed_parts(spark):
    rng = random.Random(4)
    costs = chat.Costs(patch=16, sound_rate=2, page_tokens=100, count_text=len)

    def part():
        kind = rng.choice(["text", None, "image", "audio", "document"])
        return rng.choice([None, (kind, rng.choice([None, "a #<b> \\", HOSTILE]), rng.choice([None, "r"]), rng.choice([None, 30]), rng.choice([None, 17]), rng.choice([None, 1.5]), rng.choice([None, 3]))])

    turns = {(c, t): (rng.choice(["user", "assistant", "a:b", None]), rng.choice([None, [], [part() for _ in range(rng.randint(1, 9))]])) for c in [*range(12), None] for t in range(5)}
    turns |= {(50, t): ("assistant", [("image", None, "x", 16, 16, None, None)] * 2) for t in range(300)}  # numbers of several digits
    rows = [(c, t, role, parts, "clash") for (c, t), (role, parts) in turns.items()]
    rng.shuffle(rows)
    schema = T.StructType.fromDDL("conv_id long, turn long, role string, formatted string")
    schema = T.StructType([*schema.fields[:3], T.StructField("parts", T.ArrayType(chat.PART)), schema.fields[3]])
    df = spark.createDataFrame(rows, schema)
    got = {}
    out = chat.format_conversations(df, costs=costs)
    for r in sorted(out.collect(), key=lambda r: r.position):
        got.setdefault(r.conv_id, []).append(r)
    totals = {r.conv_id: r for r in chat.summaries(out).collect()}
    assert set(got) == {c for c, _ in turns}
    for c, made in got.items():
        text, spans, refs, tokens = plain_conversation([turns[k] for k in sorted((k for k in turns if k[0] == c), key=lambda k: k[1])], costs)
        assert [r.position for r in made] == list(range(1, len(made) + 1))
        assert "".join(r.formatted for r in made) == text and all(text[r.starts_at :].startswith(r.formatted) for r in made)
        assert [(s.start, s.stop) for r in made for s in r.loss_spans] == spans
        assert [tuple(a) for r in made for a in r.attachments] == refs
        t = totals[c]
        assert (t.n_turns, t.formatted_chars, t.n_attachments, t.tokens) == (len(made), len(text), len(refs), tokens)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_formatted_chars_and_unknown_parts(spark):
    got = chat.conversation_digests(spark.createDataFrame([(1, 0, "user", "a#b"), (1, 1, "assistant", "")], "conv_id long, turn long, role string, text string")).first()
    assert got.formatted_chars == len("### user:\na\\#b</turn>\n### assistant:\n</turn>\n")
    text, _, refs, tokens = chat.format_turn("user", [{"type": "video", "ref": "v"}], numbered=4, strict=False)
    assert text == "### user:\n<attachment 5></turn>\n" and (refs[0]["ref"], refs[0]["number"], tokens) == ("v", 5, 0)
    assert chat.format_turn("user", [{"type": "image", "width": -3, "height": 9}, {"type": "audio", "seconds": float("nan")}])[3] == 0
