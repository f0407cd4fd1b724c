"""Secret scans with multipart credential linking. Native: regular expressions, windows and aggregates only.

Base kinds are reported wherever they stand. The method adds weak candidates - identifiers, short or lone secrets and
endpoints that alone say nothing - where a complementary part stands in the same scope. Scopes come from the text:
blocks between blank lines, or the whole text where it has none; however far apart, parts of a scope belong together.
A complement is another stretch of text: what overlaps a part, such as the value of an identifier or the path of an
endpoint, completes nothing. Scopes are intervals that parts join by their places, and a scope's outermost parts of
each class tell whether a part has a disjoint complement, so no pair of parts is put out.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceloom.llm.store import prefix_for, save

#: Base patterns and the least length of the part that counts.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Weak parts: an account or key identifier with its value, a lone mixed token of 20 and more characters, an endpoint, and an assigned value too short for the base.
IDENTIFIER = r"(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)\b[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,})"
LONE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"(?i:\b(?:https?|postgres(?:ql)?|mysql|redis|amqp|mongodb|ftp|ssh)://[^\s\"'<>]+)"

#: What parts one scope from the next: a blank line.
BREAK = r"\n[\x20\t\r]*\n[\x20\t\r\n]*"

#: pattern -> (regular expression, group whose length counts, least length, kind from that length on, least length and kind below it)
PATTERNS = {
    "assign": (ASSIGN, 1, 12, "assign", 4, "short"),
    "access": (ACCESS, 0, 18, "access", 0, None),
    "hex": (HEX, 0, 16, "hex", 0, None),
    "identifier": (IDENTIFIER, 0, 1, "identifier", 0, None),
    "lone": (LONE, 0, 20, "lone", 0, None),
    "endpoint": (ENDPOINT, 0, 1, "endpoint", 0, None),
    "break": (BREAK, 0, 1, "break", 0, None),
}
BASE = ("assign", "access", "hex")
#: Kinds in the order of spans that begin together.
KINDS = ("assign", "access", "hex", "identifier", "lone", "endpoint", "short")
#: What a match must hold besides, each somewhere in it.
HOLDS = {"lone": ("[0-9]", "[A-Z]", "[a-z]")}
#: What a part is in a credential. A run of hex digits may be the hash of something public, so it is a class of its own.
PART_OF = {"assign": "secret", "access": "id", "hex": "digits", "identifier": "id", "lone": "secret", "endpoint": "endpoint", "short": "secret"}
#: What a weak part needs beside it: an identifier a secret or digits, a secret an identifier or endpoint, an endpoint a secret.
NEEDS = {"identifier": ("secret", "digits"), "lone": ("id", "endpoint"), "short": ("id", "endpoint"), "endpoint": ("secret",)}
_FOUND = "array<struct<pattern:string,gap:int,n:int,kind:string>>"


def _found(text: Column, pattern: str) -> Column:
    """[(pattern, code points since its last match, of this match, kind or null where it does not count)] in order.

    What stands between matches comes from splitting at them; texts without a match are only searched once.
    """
    rx, group, least, kind, low, below = PATTERNS[pattern]
    matches = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rx), F.lit(group)) if group else matches
    holds = lambda m: reduce(and_, (F.rlike(m, F.lit(p)) for p in HOLDS.get(pattern, ())), F.lit(True))
    name = lambda x: F.when((F.length(x["c"]) >= least) & holds(x["m"]), F.lit(kind)).when((F.length(x["c"]) < least) & (F.length(x["c"]) >= low), F.lit(below).cast("string"))
    rows = F.transform(
        F.arrays_zip(F.slice(F.split(text, rx, -1), F.lit(1), F.size(matches)).alias("g"), matches.alias("m"), counted.alias("c")),
        lambda x: F.struct(F.lit(pattern).alias("pattern"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("n"), name(x).alias("kind")),
    )
    return F.when(F.rlike(text, F.lit(rx)), rows).otherwise(F.array().cast(_FOUND))


def places(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, _text, kind, start, end, scope) of every part that counts; a row without any has one with a null kind.

    Texts are read once and never shuffled; only the parts are, by row, and the table is written. Blank lines are only
    looked for in texts with weak parts; scope is the number of them before a part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.xxhash64(text).alias("_text"), text.alias("_whole"), F.concat(*[_found(text, k) for k in PATTERNS if k != "break"]).alias("_found"))
    weak = F.exists("_found", lambda x: F.coalesce(x["kind"].isin(*NEEDS), F.lit(False)))
    parts = parts.withColumn("_found", F.concat("_found", F.when(weak, _found(F.col("_whole"), "break")).otherwise(F.array().cast(_FOUND)))).drop("_whole")
    each = parts.select("_row", "doc_id", "_text", F.posexplode_outer("_found").alias("_no", "_part")).select("_row", "doc_id", "_text", "_no", "_part.*")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("_row", "pattern").orderBy("_no"))).withColumn("start", F.col("end") - F.col("n"))
    breaks = F.count(F.when(F.col("pattern") == "break", 1)).over(Window.partitionBy("_row").orderBy("start", "end"))
    scoped = placed.withColumn("scope", breaks).where("pattern is null or pattern <> 'break'")
    return save(scoped.select("_row", "doc_id", "_text", "kind", "start", "end", "scope"), "parts")


def _case(value, of) -> Column:
    return F.expr("case kind " + " ".join(f"when '{k}' then {value(k)}" for k in of) + " end")


def linked(placed: DataFrame) -> DataFrame:
    """The weak parts of places() with a disjoint complement in the same scope.

    A part has one if the complements' first end is not after its start, or their last start not before its end: two
    figures a scope and class, so the work is linear however many parts a scope holds.
    """
    part = _case(lambda k: f"'{PART_OF[k]}'", KINDS)
    scope = Window.partitionBy("_row", "scope")
    kinds = sorted(set(PART_OF.values()))
    ends = {f"_{f.__name__}_{c}": f(F.when(part == c, F.col(x))).over(scope) for c in kinds for f, x in ((F.min, "end"), (F.max, "start"))}
    beside = lambda c: f"coalesce(_min_{c} <= start, false) or coalesce(_max_{c} >= end, false)"
    has = _case(lambda k: f"({' or '.join(map(beside, NEEDS[k]))})", NEEDS)
    return placed.where("kind is not null").withColumns(ends).where(F.col("kind").isin(*NEEDS) & has).select(*placed.columns)


def spans(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, `_text` (a hash of the text) and `found`: its spans, array of (start, rank, kind, end, before), by start and then kind as listed in KINDS; before is the last end of earlier ones.

    Places are code points, ends exclusive. A null or empty text has none; equal rows have equal spans and stay
    apart; other columns play no part; an empty table gives an empty table.
    """
    placed = places(docs)
    base = placed.where(F.col("kind").isNull() | F.col("kind").isin(*BASE))
    rest = placed.select("_row", "doc_id", "_text").withColumns({"kind": F.lit(None).cast("string"), "start": F.lit(None).cast("long"), "end": F.lit(None).cast("long"), "scope": F.lit(None).cast("long")})
    every = base.unionByName(linked(placed)).unionByName(rest).withColumn("rank", _case(lambda k: KINDS.index(k), KINDS))
    before = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(Window.partitionBy("_row").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "rank", "kind", "end", "before"))
    return every.withColumn("before", before).groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("_text").alias("_text"), F.sort_array(F.collect_list(span)).alias("found")).drop("_row")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the digest of spans() for every row."""
    found = spans(docs)
    shown = lambda kinds: F.array_join(F.transform(F.filter("found", lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.encode(shown(BASE), "UTF-8"), 256).alias("base_sha256"), shown(KINDS).alias("spans"))


#: Code points of the pieces that a text is cut into before spans are taken from it.
PIECE = 4096


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text given in pieces of PIECE: the work follows what is taken, not how far on it stands."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    at, to = (a - i * PIECE).cast("int"), (b - j * PIECE).cast("int")
    part = lambda n: F.coalesce(F.get(pieces, n), F.lit(""))
    over = F.concat(F.substring(part(i), at + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(F.lit(0), j - i - 1)), ""), F.substring(part(j), F.lit(1), to))
    return F.when(i == j, F.substring(part(i), at + 1, to - at)).otherwise(over)


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span found cut from its text and `mark` in its place; overlapping spans become one. Rows and columns stay.

    Only rows with spans are joined back, by id and text hash; a null text stays null. Texts are cut into pieces once, so
    the work is in proportion to text and spans. Other columns may have any name; an empty table gives an empty table.
    """
    own = prefix_for(docs)
    hits = spans(docs).where(F.size("found") > 0).dropDuplicates(["doc_id", "_text"]).select(F.col("doc_id").alias(f"{own}id"), F.col("_text").alias(f"{own}hash"), F.col("found").alias(f"{own}found"))
    same = F.col("doc_id").eqNullSafe(F.col(f"{own}id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(f"{own}hash"))
    joined = docs.join(hits, same, "left")
    text, found = F.col("text"), F.col(f"{own}found")
    heads = F.filter(found, lambda x: x["before"].isNull() | (x["start"] >= x["before"]))
    last = F.array_max(F.transform(found, lambda x: x["end"]))
    joined = joined.withColumn(f"{own}pieces", F.when(found.isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))).withColumn(f"{own}heads", heads)
    heads, pieces = F.col(f"{own}heads"), F.col(f"{own}pieces")
    kept = F.transform(heads, lambda x: _between(pieces, F.coalesce(x["before"], F.lit(0)), x["start"]))
    done = F.array_join(F.concat(kept, F.array(_between(pieces, last, F.length(text)))), mark)
    return joined.select(*[F.when(found.isNull(), text).otherwise(done).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
