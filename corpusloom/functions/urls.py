"""URL functions as Spark columns: all run inside whole-stage code, none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
EXTENSION = r"(?i)\.(html?|shtml|aspx?|php)$"
#: Letters with marks and their plain forms, for the alphabets in use (d with stroke included).
MARKED = "àáâãäåāăąèéêëēęěìíîïīòóôõöøōőùúûüūůűýÿñńňçćčđśšßźžżłř"
PLAIN = "aaaaaaaaaeeeeeeeiiiiioooooooouuuuuuuyynnncccdssszzzlr"


def bare(url: Column) -> Column:
    """Without white space around, fragment and scheme."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), SCHEME, "")


def netloc(url: Column) -> Column:
    return F.regexp_extract(bare(url), r"^([^/?]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(bare(url), r"^[^/?]*([^?]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(bare(url), r"\?(.*)$", 1)


def domain(url: Column) -> Column:
    """Lower-case host without user and ``www.``; the port stays."""
    return F.regexp_replace(F.lower(F.regexp_replace(netloc(url), r"^.*@", "")), r"^www\.", "")


def normal(url: Column) -> Column:
    """Key that scheme, www, default ports, fragment and trailing slashes do not change; path case and query count."""
    host = F.regexp_replace(domain(url), r":(80|443)$", "")
    q = query_string(url)
    return F.concat(host, F.regexp_replace(path(url), r"/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def loose_key(url: Column) -> Column:
    """As ``normal`` without the query, but with the port."""
    return F.concat(domain(url), F.regexp_replace(path(url), r"/+$", ""))


def surt(url: Column) -> Column:
    """Sort-friendly key: reversed host, path, sorted parameters."""
    host = F.regexp_replace(domain(url), r":[0-9]+$", "")
    p, q = path(url), query_string(url)
    sorted_q = F.array_join(F.array_sort(F.split(q, "&")), "&")
    return F.concat(
        F.array_join(F.reverse(F.split(host, r"\.")), ","),
        F.lit(")"),
        F.when(p == "", F.lit("/")).otherwise(p),
        F.when(q != "", F.concat(F.lit("?"), sorted_q)).otherwise(F.lit("")),
    )


def variants(url: Column) -> Column:
    """Spellings under which an archive may hold the page."""
    key = normal(url)
    return F.array(*[F.concat(F.lit(s), key) for s in ("http://", "https://", "http://www.", "https://www.")])


def plain_letters(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def stem(url: Column) -> Column:
    last = F.coalesce(F.element_at(F.slice(F.reverse(segments(url)), 1, 1), 1), F.lit(""))
    return F.regexp_replace(F.coalesce(F.try_url_decode(last), last), EXTENSION, "")


def slug_tokens(url: Column) -> Column:
    return F.regexp_extract_all(plain_letters(stem(url)), F.lit("([a-z0-9]+)"), 1)


def alpha_tokens(url: Column) -> Column:
    return F.filter(slug_tokens(url), lambda t: t.rlike("^[a-z]{2,}$"))


def parents(url: Column, n: int) -> Column:
    s = segments(url)
    head = F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
    joined = F.array_join(F.slice(head, 1, n), "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def last_number(url: Column) -> Column:
    numbers = F.regexp_extract_all(stem(url), F.lit("([0-9]+)"), 1)
    return F.try_element_at(numbers, F.lit(-1)).try_cast("long")


def semantic_slug(url: Column) -> Column:
    s = stem(url)
    return F.when(s.rlike("[㐀-鿿]") | s.rlike("^[A-Za-z]+([-_ ][A-Za-z]+)*$"), F.regexp_replace(s, "[-_]+", " ")).otherwise(F.lit(""))


def slug_type(url: Column) -> Column:
    s = stem(url)
    return (
        F.when(s.rlike("[㐀-鿿]"), "cjk")
        .when(s.rlike("^[0-9]+$"), "numeric_id")
        .when(F.size(slug_tokens(url)) >= 3, "meaningful")
        .otherwise("other")
    )
