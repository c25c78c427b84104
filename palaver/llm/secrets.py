"""Operator 6: secret scan with multipart credential linking. DataFrame functions only.

Parts of six kinds are cut out of a text by regular expressions. The base kinds (assign, access, hex) are always reported. The weak
kinds are reported only where a complementary part lies in the same scope, that is within ``SCOPE`` code points:

* ``weak``: a 32+ character token that mixes upper case, lower case and digits, with no keyword: a secret;
* ``ident``: a user, client or access key name assigned with a keyword: an identifier;
* ``endpoint``: a URL.

assign, hex and weak are secrets; access, ident and endpoint are what a secret opens. The interval join of the two sides is a sweep: along
a document's parts, ordered by start, the furthest end so far (and, in the other direction, the nearest start to come)
of either side tells whether a partner is in reach. That needs one shuffle of small rows and never makes pairs.

Offsets: the lengths of the pieces between matches and of the matches themselves, summed along the text.

Defined results: null and empty texts have no parts; overlapping parts of different kinds are all reported; rows that
repeat a doc_id each get a row; null doc_ids are carried through; very long texts are read whole; an empty table gives no row. Only id and text are read;
``redact`` returns all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, free_name, join_counted, join_narrow, materialise, read_table

SCOPE = 400
MASK = "[SECRET]"


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_VALUE = r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
NAMES = _any_case("client") + "_?" + _any_case("id") + "|" + _any_case("user") + "(?:" + _any_case("name") + ")?|" + _any_case("access") + "_?" + _any_case("key") + "_?" + _any_case("id")

#: kind -> pattern. [0-9a-f]{24,} and AKIA[A-Z0-9]{16,} are the matches of the contract's patterns that are long enough.
PATTERNS = {
    "assign": f"({KEYWORDS}){_VALUE}",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "ident": f"({NAMES}){_VALUE}",
    "endpoint": r"https?://[A-Za-z0-9._:/?&=%@-]+",
    "weak": "[A-Za-z0-9+/]{32,}",
}
KINDS = list(PATTERNS)
BASE, SECRETS = ("assign", "access", "hex"), ("assign", "hex", "weak")
_PART = "array<struct<kind:int,idx:int,gap:int,len:int,ok:boolean>>"


def _parts(text: Column, found: Column, kind: str) -> Column:
    pieces = F.split(text, PATTERNS[kind], -1)
    if kind == "assign":
        fits = lambda m: F.length(F.regexp_extract(m, f"^{PATTERNS[kind]}", 2)) >= 6
    elif kind == "weak":
        fits = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    else:
        fits = lambda m: F.lit(True)
    part = lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.cast("int").alias("idx"), F.length(F.get(F.col(f"pieces_{kind}"), i)).alias("gap"), F.length(m).alias("len"), fits(m).alias("ok"))
    return F.coalesce(F.transform(found, part).cast(_PART), F.expr(f"cast(array() as {_PART})")), pieces


def find_parts(docs: DataFrame) -> DataFrame:
    """docs(rid, doc_id, text) -> (rid, doc_id, kind, start, end, linked); one row without a kind where a text has none."""
    text = F.col("text")
    hint = {"access": text.contains("AKIA"), "endpoint": text.contains("://")}
    rows = docs.select("rid", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        all_of = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        rows = rows.withColumn(f"found_{kind}", F.when(hint[kind], all_of) if kind in hint else all_of)
    columns = []
    for kind in KINDS:
        column, pieces = _parts(text, F.col(f"found_{kind}"), kind)
        rows = rows.withColumn(f"pieces_{kind}", F.when(F.size(f"found_{kind}") > 0, pieces))
        columns.append(column)
    parts = rows.select("rid", "doc_id", F.explode_outer(F.concat(*columns)).alias("part")).select("rid", "doc_id", "part.*").repartition("rid")
    along = Window.partitionBy("rid", "kind").orderBy("idx")
    placed = parts.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(along)).withColumn("start", F.col("end") - F.col("len"))
    placed = placed.filter(F.col("kind").isNull() | F.col("ok") | (F.col("idx") == 0)).withColumn("kind", F.when(F.coalesce("ok", F.lit(False)), F.col("kind")))
    secret = F.col("kind").isin(*(KINDS.index(k) for k in SECRETS))
    forward = Window.partitionBy("rid").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("rid").orderBy(F.col("start").desc(), F.col("kind").desc(), F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    mine = F.when(secret, "opens").otherwise("secret")
    for side, of in (("secret", secret), ("opens", ~secret)):
        placed = placed.withColumn(f"before_{side}", F.max(F.when(of, F.col("end"))).over(forward))
    for side, of in (("secret", secret), ("opens", ~secret)):
        placed = placed.withColumn(f"after_{side}", F.min(F.when(of, F.col("start"))).over(backward))
    reach = lambda side: F.coalesce(F.col("start") - F.col(f"before_{side}") <= SCOPE, F.lit(False)) | F.coalesce(F.col(f"after_{side}") - F.col("end") <= SCOPE, F.lit(False))
    linked = F.when(mine == "opens", reach("opens")).otherwise(reach("secret"))
    return placed.select("rid", "doc_id", "kind", "start", "end", linked.alias("linked"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end; sorted by start, then kind) for each row of ``docs(doc_id, text)``."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = find_parts(rows)
    kept = F.col("kind").isNotNull() & (F.col("kind").isin(*(KINDS.index(k) for k in BASE)) | F.col("linked"))
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("kind"), F.col("end").cast("long").alias("end"))
    return parts.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(kept, span))).alias("spans")).drop("rid")


def digest(found: DataFrame) -> DataFrame:
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(F.concat_ws(",", F.transform(base, name)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", name)).alias("spans"))


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every reported span replaced by ``mask``; all other columns and rows stay as they are.

    Spans are found row by row, so repeated rows do not mix, and joined back once for each id and hash and length of a text.
    """
    names = [free_name(c, docs.columns) for c in ("id_hash", "text_hash", "text_length")]
    cuts, n = (free_name(c, docs.columns) for c in ("cuts", "n"))
    keyed = docs
    for name, value in zip(names, (F.xxhash64(F.col("doc_id").cast("long")), F.xxhash64("text"), F.coalesce(F.length("text"), F.lit(-1)))):
        keyed = keyed.withColumn(name, value.cast("long"))
    rows = keyed.select(F.monotonically_increasing_id().alias("rid"), F.struct(*names).alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = find_parts(rows).filter(F.col("kind").isNotNull() & (F.col("kind").isin(*(KINDS.index(k) for k in BASE)) | F.col("linked"))).select("rid", F.col("doc_id").alias("key"), "start", "end")
    so_far = Window.partitionBy("rid").orderBy("start", "end")
    islands = parts.withColumn("new", F.when(F.col("start") <= F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)).withColumn("island", F.sum("new").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("rid", "key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("rid", "key").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias(cuts))
    # rows of one key have the same cuts
    counted = materialise(merged.groupBy("key").agg(F.count(F.lit(1)).alias(n), F.min(cuts).alias(cuts)).select(*(F.col("key")[c].alias(c) for c in names), n, cuts))
    entries = counted.agg(F.sum(F.size(cuts) + 1)).first()[0] or 0
    few = entries <= BROADCAST_ROWS
    joined = join_narrow(keyed, counted.drop(n), names, "left", entries) if few else join_counted(keyed, counted, names, n, how="left")
    before = lambda c, i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(cuts), i - 1)["end"])
    gaps = F.transform(cuts, lambda c, i: F.substring(F.col("text"), before(c, i) + 1, c["start"] - before(c, i)))
    last = F.element_at(F.col(cuts), -1)["end"]
    clean = F.concat(F.concat_ws(mask, gaps), F.lit(mask), F.substring(F.col("text"), last + 1, F.length("text")))
    return joined.select(*(F.when(F.col(cuts).isNull(), F.col("text")).otherwise(clean).alias("text") if c == "text" else F.col(c) for c in docs.columns))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(read_table(spark, sf_dir, "documents", "doc_id", "text")))


def _oracle() -> str:
    quoted = {k: "'" + p.replace("'", "''") + "'" for k, p in PATTERNS.items()}
    ok = {"assign": f"length(regexp_extract(m, {quoted['assign']}, 2)) >= 6", "weak": "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"}
    cut = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, idx, upto - length(m) AS s, upto AS e, {ok.get(k, 'true')} AS ok FROM (SELECT doc_id, idx, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY idx) AS upto "
        f"FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS idx, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS gap FROM (SELECT doc_id, regexp_extract_all(text, {quoted[k]}) AS ms, string_split_regex(text, {quoted[k]}) AS ps FROM d)))"
        for i, k in enumerate(KINDS)
    )
    secrets = ", ".join(str(KINDS.index(k)) for k in SECRETS)
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT *, kind IN ({secrets}) AS secret, {names}[kind + 1] || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS name FROM ({cut}) WHERE ok),
l AS (SELECT *, EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND o.secret <> p.secret AND o.s - p.e <= {SCOPE} AND p.s - o.e <= {SCOPE}) AS linked FROM p),
k AS (SELECT * FROM l WHERE kind < {len(BASE)} OR linked)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(name, ',' ORDER BY s, kind, e) FILTER (WHERE kind < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(name, ',' ORDER BY s, kind, e), '') AS spans
FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id"""


ORACLE = _oracle()
