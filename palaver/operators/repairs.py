"""Repairs: verification, tables of reparandum/interregnum/repair, renaming, and conversion between the two tag schemes.

Frames hold one row per word with conv_id, utt, idx, word and a tag column. Repairs are keyed by (conv_id, utt, id).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.functions import tags as tag_functions

UTT = ["conv_id", "utt"]
#: How far back a reparandum may start in the left-to-right scheme.
MAX_BACK = 8

_ID_ATOM = r'<([a-z]+) id="([0-9]+)"/>'


def repair_atoms(df: DataFrame, tag: str = "tag") -> DataFrame:
    """One row per repair atom: conv_id, utt, idx, kind (rms, rm, i, rps, rp, rpnrep, ...), id."""
    found = df.select(*UTT, "idx", F.explode(F.regexp_extract_all(F.col(tag), F.lit(_ID_ATOM), F.lit(0))).alias("atom"))
    return found.select(*UTT, "idx", F.regexp_extract("atom", _ID_ATOM, 1).alias("kind"), F.regexp_extract("atom", _ID_ATOM, 2).cast("int").alias("id"))


def repair_spans(df: DataFrame, tag: str = "tag") -> DataFrame:
    """conv_id, utt, id, rms, rps, rpn (word indices, null if missing), last_rp and end_type (rep, sub, del) of every repair."""
    at = lambda cond, pick=F.min: pick(F.when(cond, F.col("idx")))
    kind = F.col("kind")
    return repair_atoms(df, tag).groupBy(*UTT, "id").agg(
        at(kind == "rms").alias("rms"), at(kind == "rm", F.max).alias("last_rm"), at(kind == "i").alias("first_i"), at(kind == "rps").alias("rps"), at(kind == "rp", F.max).alias("last_rp"), at(kind.startswith("rpn")).alias("rpn"),
        F.max(F.when(kind.startswith("rpn"), F.substring("kind", 4, 3))).alias("end_type"),
    )


def verify(df: DataFrame, tag: str = "tag") -> DataFrame:
    """conv_id, utt, id, ok, reason: every repair needs a reparandum start, a repair start and an end, in that order."""
    spans = repair_spans(df, tag)
    reason = (
        F.when(F.col("rms").isNull(), "no reparandum start")
        .when(F.col("rps").isNull(), "no repair start")
        .when(F.col("rpn").isNull(), "no repair end")
        .when(F.col("rms") >= F.col("rps"), "reparandum starts behind the repair")
        .when(F.coalesce(F.col("last_rm") >= F.col("rps"), F.lit(False)), "reparandum inside the repair")
        .when(F.coalesce((F.col("first_i") <= F.col("rms")) | (F.col("first_i") >= F.col("rps")), F.lit(False)), "interregnum out of place")
        .when(F.col("rpn") < F.col("rps"), "repair ends before it starts")
        .when(F.coalesce(F.col("last_rp") > F.col("rpn"), F.lit(False)), "repair goes on behind its end")
    )
    return spans.select(*UTT, "id", reason.isNull().alias("ok"), reason.alias("reason"))


def repair_table(df: DataFrame, tag: str = "tag", context: int = 10) -> DataFrame:
    """conv_id, utt, id, start (index of the repair), reparandum, interregnum, repair (words, joined by blanks), type and the
    words before the reparandum and behind the repair's start."""
    atoms = repair_atoms(df, tag).join(df.select(*UTT, "idx", "word"), [*UTT, "idx"])
    kind = F.col("kind")
    part = lambda *kinds: F.concat_ws(" ", F.transform(F.array_sort(F.collect_set(F.when(kind.isin(*kinds), F.struct("idx", "word")))), lambda s: s["word"]))
    ends = ("rpn", "rpnrep", "rpnsub")
    rows = atoms.groupBy(*UTT, "id").agg(F.min(F.when(kind == "rps", F.col("idx"))).alias("start"), part("rms", "rm").alias("reparandum"), part("i").alias("interregnum"), part("rps", "rp", *ends).alias("repair"), F.max((kind == "rpndel").cast("int")).alias("deleted"))
    kind_of = F.when(F.col("deleted") == 1, "del").when(F.col("reparandum") == F.col("repair"), "rep").otherwise("sub")
    lines = df.groupBy(*UTT).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda s: s["word"]).alias("line"))
    at = F.col("start")
    before = F.slice("line", F.greatest(at - context, F.lit(0)) + 1, F.least(at, F.lit(context)))
    after = F.slice("line", at + 1, context)
    return rows.filter("start is not null").join(lines, UTT).select(*UTT, "id", "start", "reparandum", "interregnum", "repair", kind_of.alias("type"), F.concat_ws(" ", before).alias("left_context"), F.concat_ws(" ", after).alias("right_context"))


def reparanda(df: DataFrame, tags: list[str]) -> DataFrame:
    """side (the name of the tag column), conv_id, utt, idx (the first word) and the words of the reparandum of every repair with an onset, of several taggings in one pass."""
    atom = '<(rms|rm|rps) id="([0-9]+)"/>'
    sides = F.explode(F.array(*(F.struct(F.lit(t).alias("side"), F.regexp_extract_all(F.col(t), F.lit(atom), F.lit(0)).alias("atoms")) for t in tags)))
    each = df.select(*UTT, "idx", "word", sides.alias("s")).select(*UTT, "idx", "word", "s.side", F.explode("s.atoms").alias("atom"))
    kind, ident = F.regexp_extract("atom", atom, 1), F.regexp_extract("atom", atom, 2)
    said = F.transform(F.array_sort(F.collect_set(F.when(kind != "rps", F.struct("idx", "word")))), lambda w: w["word"])
    whole = each.groupBy("side", *UTT, ident.alias("id")).agg(F.min(F.when(kind == "rms", F.col("idx"))).alias("rms"), F.max((kind == "rps").cast("int")).alias("onset"), F.concat_ws(" ", said).alias("reparandum"))
    return whole.filter("onset = 1 and rms is not null").select("side", *UTT, F.col("rms").alias("idx"), "reparandum")


def _replace_ids(tag: Column, new: Column) -> Column:
    """Atoms of ``tag`` with ids looked up in the map ``new`` (string to string); ids that it lacks stay."""
    id_of = lambda a: F.regexp_extract(a, 'id="([0-9]+)"', 1)
    swapped = lambda a: F.when(id_of(a) == "", a).otherwise(F.concat(F.regexp_extract(a, '^(<[a-z]+ id=")', 1), F.coalesce(F.element_at(new, id_of(a)), id_of(a)), F.lit('"/>')))
    return F.array_join(F.transform(tag_functions.atoms(tag), swapped), "")


def rename_repairs(df: DataFrame, tag: str = "tag", at: str = "idx") -> DataFrame:
    """``df`` with every repair named after the place (``at``) of its onset. A repair without an end gets ``<rpnsub>`` on its last word."""
    spans = repair_spans(df, tag).filter("rps is not null")
    place = df.select(*UTT, F.col("idx").alias("rps"), F.col(at).cast("string").alias("name")) if at != "idx" else spans.select(*UTT, "rps", F.col("rps").cast("string").alias("name")).distinct()
    named = spans.join(place, [*UTT, "rps"])
    names = named.groupBy(*UTT).agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "name"))).alias("__names"))
    open_ends = named.filter("rpn is null").groupBy(*UTT, F.coalesce("last_rp", "rps").alias("idx")).agg(F.concat_ws("", F.array_sort(F.collect_list(F.format_string('<rpnsub id="%s"/>', "name")))).alias("__end"))
    out = df.join(names, UTT, "left").join(open_ends, [*UTT, "idx"], "left")
    renamed = F.when(F.col("__names").isNull(), F.col(tag)).otherwise(_replace_ids(F.col(tag), F.col("__names")))
    return out.withColumn(tag, F.concat(renamed, F.coalesce("__end", F.lit("")))).drop("__names", "__end")


#: What ``to_incremental`` can carry over from a tag beside its repairs: pattern of the atom, and what stands for none.
CARRIED = {"uttseg": ("(<[ct]*/>)", ""), "dact": ('(<diact type="[^\\s"]*"/>)', ""), "laugh": ("(<speechLaugh/>|<laughter/>)", "<nolaughter/>")}


def to_incremental(df: DataFrame, tag: str = "gold", limit: int = MAX_BACK, carry: tuple[str, ...] = ("uttseg",), count_edits: bool = True) -> DataFrame:
    """``df`` with ``inc``: tags that a left-to-right reader can give. A repair onset says how far back the reparandum starts (at most
    ``limit``; without ``count_edits`` edit terms in between do not count); the end says substitution or deletion, after the repair with the longest reparandum. ``carry`` names what else is kept of a tag, in that order."""
    edited = F.col(tag).contains("<e/>") | F.col(tag).contains("<i")
    spans = repair_spans(df, tag).filter("rms is not null and rps is not null").withColumn("back", F.least(F.col("rps") - F.col("rms"), F.lit(limit)))
    if not count_edits:
        plain = df.select(*UTT, "idx", F.sum((~edited).cast("int")).over(Window.partitionBy(*UTT).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)).alias("__plain"))
        at = lambda c: plain.select(*UTT, F.col("idx").alias(c), F.coalesce("__plain", F.lit(0)).alias(f"__{c}"))
        spans = spans.join(at("rms"), [*UTT, "rms"]).join(at("rps"), [*UTT, "rps"]).withColumn("back", F.least(F.col("__rps") - F.col("__rms"), F.lit(limit)).cast("int"))
    onsets = spans.groupBy(*UTT, F.col("rps").alias("idx")).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("id", "back"))), lambda s: F.concat(F.lit("<rm-"), s["back"].cast("string"), F.lit("/>")))).alias("__onset"))
    ends = spans.filter("rpn is not null").groupBy(*UTT, F.col("rpn").alias("idx")).agg(F.max(F.struct("back", F.when(F.col("end_type") == "del", 0).otherwise(1).alias("sub"))).alias("__end"))
    out = df.join(onsets, [*UTT, "idx"], "left").join(ends, [*UTT, "idx"], "left")
    onset = F.coalesce(F.col("__onset"), F.lit(""))
    ended = F.col("__end").isNotNull()
    body = F.concat(F.when(edited, "<e/>").otherwise(""), onset, F.when((onset != "") & ~ended, "<rpMid/>").otherwise(""), F.when(ended, F.when(F.col("__end.sub") == 1, "<rpEndSub/>").otherwise("<rpEndDel/>")).otherwise(""))
    found = [F.regexp_extract(tag, pattern, 1) for pattern, _ in (CARRIED[c] for c in carry)]
    kept = [F.when(f == "", none).otherwise(f) for f, (_, none) in zip(found, (CARRIED[c] for c in carry))]
    return out.withColumn("inc", F.concat(F.when(body == "", "<f/>").otherwise(body), *kept)).drop("__onset", "__end")


#: What was read of tags; a session sees the same few again and again.
_READ: dict[str, tuple[str, bool, int | None, bool]] = {}


def _read_tag(tag: str) -> tuple[str, bool, int | None, bool]:
    """Of a left-to-right tag: its segmentation atom, whether it is an edit term, how far back its onset reaches (None: no onset) and whether it ends repairs."""
    if tag not in _READ:
        if len(_READ) >= 10_000:
            _READ.clear()
        m = re.search("<rm-([0-9]+)/>", tag)
        _READ[tag] = (re.search("<[ct]*/>", tag) or [""])[0], "<e/>" in tag or "<i/>" in tag, int(m[1]) if m else None, "<rpEndDel/>" in tag or "<rpEndSub/>" in tag
    return _READ[tag]


def eval_tags(tags: list[str], words: list[str], simple: bool = False, base: int = 0) -> list[str]:
    """Left-to-right tags of one utterance as evaluation tags; the inverse of ``to_incremental`` where no reparandum was cut short.

    Repairs are named after their onset, counted from ``base`` for the first word. Words between onset and end are in the repair; an end closes every open repair.
    """
    read = [_read_tag(t) for t in tags]
    segment, edit = [r[0] for r in read], [r[1] for r in read]
    out: list[list[str]] = [["<e/>"] if e else [] for e in edit]
    back: dict[int, int] = {}
    is_open: list[int] = []
    for t, tag in enumerate(tags):
        reach = read[t][2]
        if reach is not None:
            if not simple:
                first = max(0, t - reach)
                back[t] = first
                out[first].insert(0, f'<rms id="{base + t}"/>')
                between = t - 1
                while between > first and edit[between]:
                    out[between].insert(0, f'<i id="{base + t}"/>')
                    between -= 1
                for b in range(first + 1, between + 1):
                    out[b].insert(0, f'<rm id="{base + t}"/>')
                is_open.append(t)
            out[t].append(f'<rps id="{base + t}"/>')
        ending = read[t][3]
        for r in list(is_open):
            if ending:
                said = words[r : t + 1]
                repaired = [words[b] for b in range(back[r], r) if f'<rms id="{base + r}"/>' in out[b] or f'<rm id="{base + r}"/>' in out[b]]
                kind = "del" if "<rpEndDel/>" in tag else "rep" if repaired == said else "sub"
                out[t].append(f'<rpn{kind} id="{base + r}"/>')
                is_open.remove(r)
            elif t > r:
                out[t].append(f'<rp id="{base + r}"/>')
    return [("".join(o) or "<f/>") + s for o, s in zip(out, segment)]


def to_eval(df: DataFrame, tag: str = "inc", simple: bool = False) -> DataFrame:
    """conv_id, utt, idx, tag: evaluation tags from left-to-right tags, an utterance a row."""
    part = lambda c: F.transform("said", lambda s: s[c])
    lines = df.groupBy(*UTT).agg(F.array_sort(F.collect_list(F.struct("idx", "word", F.col(tag).alias("tag")))).alias("said")).select(*UTT, part("idx").alias("idx"), part("word").alias("word"), part("tag").alias("tag"))

    def run(batches):
        for batch in batches:
            found = [eval_tags(t, w, simple) for t, w in zip(batch["tag"].to_pylist(), batch["word"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["utt"], batch["idx"], pa.array(found, pa.list_(pa.string()))], names=[*UTT, "idx", "tag"])

    kinds = dict(lines.dtypes)
    found = lines.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*UTT, "idx", "tag")))
    each = found.select(*UTT, F.explode(F.arrays_zip("idx", "tag")).alias("t"))
    return each.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("utt").cast("long").alias("utt"), F.col("t.idx").cast("int").alias("idx"), F.col("t.tag").alias("tag"))


def resolve_embedded(spans: DataFrame) -> DataFrame:
    """Of repairs with one onset, the one that stays: repetitions before substitutions before deletions, then the shortest reparandum."""
    rank = F.when(F.col("end_type") == "rep", 0).when(F.col("end_type") == "sub", 1).otherwise(2)
    order = Window.partitionBy(*UTT, "rps").orderBy(rank, F.col("rms").desc(), "id")
    return spans.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def relaxed_repairs(df: DataFrame, counts: DataFrame) -> DataFrame:
    """One-word substitutions on the first words of utterances: ``counts(conv_id, utt, k)`` says on how many."""
    return df.join(counts, UTT).filter((F.col("idx") >= 1) & (F.col("idx") <= F.col("k"))).select(*UTT, F.col("idx").alias("rps"), (F.col("idx") - 1).alias("rms"), F.lit("sub").alias("end_type"))


def without_partial_words(df: DataFrame, tag: str = "tag") -> DataFrame:
    """Words that break off (end in ``-``) go, with their atoms, and the rest are numbered anew."""
    kept = df.filter(~F.col("word").endswith("-"))
    return kept.withColumn("idx", (F.row_number().over(Window.partitionBy(*UTT).orderBy("idx")) - 1).cast("int"))


def ends_off_edit_terms(df: DataFrame, tag: str = "tag") -> DataFrame:
    """Repair ends and onsets that stand on an edit term move to the nearest word before (ends) or behind (onsets) that is none."""
    plain = ~F.col(tag).contains("<e")
    before = Window.partitionBy(*UTT).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*UTT).orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = df.withColumn("__before", F.max(F.when(plain, F.col("idx"))).over(before)).withColumn("__behind", F.min(F.when(plain, F.col("idx"))).over(behind))
    loose = placed.filter(~plain).select(*UTT, "__before", "__behind", F.explode(F.regexp_extract_all(F.col(tag), F.lit('<rp[ns][a-z]* id="[0-9]+"/>'), F.lit(0))).alias("atom"))
    moved = loose.select(*UTT, F.when(F.col("atom").startswith("<rps"), F.col("__behind")).otherwise(F.col("__before")).alias("idx"), "atom").filter("idx is not null").groupBy(*UTT, "idx").agg(F.concat_ws("", F.array_sort(F.collect_list("atom"))).alias("__moved"))
    bare = F.when(plain, F.col(tag)).otherwise(F.regexp_replace(tag, '<rp[ns][a-z]* id="[0-9]+"/>', ""))
    joined = df.withColumn(tag, bare).join(moved, [*UTT, "idx"], "left")
    return joined.withColumn(tag, F.concat(F.when(F.col("__moved").isNull(), F.col(tag)).otherwise(F.regexp_replace(tag, "<f/>", "")), F.coalesce("__moved", F.lit("")))).drop("__moved")


def retyped(df: DataFrame, tag: str = "tag") -> DataFrame:
    """``df`` with every repair's end (not of deletions) named by what it is: a repetition if the repair's words are the reparandum's, else a substitution."""
    wrong = repair_table(df, tag).filter("type <> 'del'").select(*UTT, F.col("id").cast("string").alias("id"), "type")
    names = wrong.groupBy(*UTT).agg(F.map_from_entries(F.collect_list(F.struct("id", "type"))).alias("__types"))
    atom_id = lambda a: F.regexp_extract(a, '^<rpn(?:rep|sub) id="([0-9]+)"/>$', 1)
    named = lambda a: F.concat(F.lit("<rpn"), F.coalesce(F.element_at("__types", atom_id(a)), F.substring(a, 5, 3)), F.lit(' id="'), atom_id(a), F.lit('"/>'))
    swapped = F.array_join(F.transform(tag_functions.atoms(F.col(tag)), lambda a: F.when(atom_id(a) == "", a).otherwise(named(a))), "")
    return df.join(names, UTT, "left").withColumn(tag, F.when(F.col("__types").isNull(), F.col(tag)).otherwise(swapped)).drop("__types")


def ends_for_open_repairs(df: DataFrame, tag: str = "tag") -> DataFrame:
    """``df`` in which every repair without an end gets one, on its last word (the onset if it has no other): ``<rpnrep>`` if its words repeat the reparandum, else ``<rpnsub>``; the ``<rp>`` atom there goes."""
    spans = repair_spans(df, tag).filter("rps is not null and rpn is null").select(*UTT, "id", F.coalesce("last_rp", "rps").alias("idx"))
    kinds = spans.join(repair_table(df, tag).select(*UTT, "id", "type"), [*UTT, "id"])
    at = kinds.groupBy(*UTT, "idx").agg(
        F.concat_ws("", F.array_sort(F.collect_list(F.format_string('<rpn%s id="%d"/>', F.when(F.col("type") == "rep", "rep").otherwise("sub"), "id")))).alias("__ends"),
        F.concat_ws("|", F.collect_list(F.col("id").cast("string"))).alias("__ids"),
    )
    out = df.join(at, [*UTT, "idx"], "left")
    bare = F.regexp_replace(F.col(tag), F.concat(F.lit('<rp id="(?:'), F.coalesce("__ids", F.lit("x")), F.lit(')"/>')), F.lit(""))
    atoms = F.regexp_extract(bare, "^(.*?)((?:<[ct]*/>)?)$", 1)
    rest = F.regexp_extract(bare, "^(.*?)((?:<[ct]*/>)?)$", 2)
    return out.withColumn(tag, F.when(F.col("__ends").isNull(), F.col(tag)).otherwise(F.concat(atoms, F.col("__ends"), rest))).drop("__ends", "__ids")


def marked_interregna(df: DataFrame, tag: str = "tag") -> DataFrame:
    """``df`` in which the edit terms in a run right before a repair onset are interregna of that repair (``<i id/>`` before ``<e/>``), if they are not yet."""
    edited = F.col(tag).contains("<e")
    back = Window.partitionBy(*UTT).orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.last(F.when(~edited, F.regexp_extract(tag, '<rps id="([0-9]+)"/>', 1)), ignorenulls=True).over(back)
    ident = F.when(edited, nearest)
    mark = F.concat(F.lit('<i id="'), ident, F.lit('"/>'))
    return df.withColumn("__mark", mark).withColumn(tag, F.when((F.coalesce(ident, F.lit("")) != "") & ~F.col(tag).contains(F.col("__mark")), F.concat("__mark", tag)).otherwise(F.col(tag))).drop("__mark")


def without_broken_repairs(df: DataFrame, tag: str = "tag") -> DataFrame:
    """``df`` without the atoms of repairs that ``verify`` refuses; a word left without any is fluent."""
    bad = verify(df, tag).filter("not ok").groupBy(*UTT).agg(F.collect_set(F.col("id").cast("string")).alias("__bad"))
    ident = lambda a: F.regexp_extract(a, ' id="([0-9]+)"', 1)
    kept = F.array_join(F.filter(tag_functions.atoms(F.col(tag)), lambda a: ~F.array_contains(F.col("__bad"), ident(a))), "")
    plain = F.when(kept.rlike("^(<[ct]*/>)?$"), F.concat(F.lit("<f/>"), kept)).otherwise(kept)
    return df.join(bad, UTT, "left").withColumn(tag, F.when(F.col("__bad").isNull(), F.col(tag)).otherwise(plain)).drop("__bad")


def cross_turn_repairs(df: DataFrame, by: list[str], order: str, word: str = "word", reach: int = 1) -> DataFrame:
    """Repairs over a turn boundary: a turn (``by`` and the turn number ``utt``) whose first word takes up the last word, or the last but one and so on up to ``reach`` words
    back, of the same speaker's turn before. One row a repair: by, utt, back (words from that word to the end of its turn), word."""
    last = Window.partitionBy(*by, "utt").orderBy(F.col(order).desc())
    ends = df.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= reach).select(*by, "utt", "back", F.col(word).alias("word"))
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "utt").orderBy(order))).filter("__n = 1").select(*by, "utt", F.col(word).alias("word"))
    before = Window.partitionBy(*by).orderBy("utt")
    starts = first.withColumn("__before", F.lag("utt").over(before)).select(*by, F.col("utt").alias("utt"), F.col("__before"), "word")
    hits = starts.join(ends.withColumnRenamed("utt", "__before"), [*by, "__before", "word"])
    return hits.groupBy(*by, "utt", "word").agg(F.min("back").alias("back")).select(*by, "utt", "back", "word")
