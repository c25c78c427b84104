"""Readers of transcript, hypothesis, annotation and model files.

Block formats (headers that hold for the lines below them) are read as lines with their place in the file: the block offset of the
split and the order within it. Headers are spread within the splits of a file, and from split to split by one row each, so a large file is read by many tasks.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Longest pause, in seconds, that a word's start may hold before its end.
MAX_WORD_S = 0.3


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line_id, value: lines without line ends (Spark's reader takes \\n, \\r\\n and \\r for one); (block, line_id) orders them within a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_id"), "value")


def spread(lines: DataFrame, **headers: Column) -> DataFrame:
    """``lines`` with, under each name, the last value of the header column that is not null, from the line or one before it in its file, and ``file_no``, a number of the file."""
    marked = lines.select("*", *(h.alias(n) for n, h in headers.items()))
    # what each split ends with is what the next one begins with; only lines with headers are sorted for it
    last = marked.filter(F.coalesce(*(F.col(n).cast("string") for n in headers)).isNotNull())
    ends = last.groupBy("file", "block").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line_id"))).alias(f"__end_{n}") for n in headers))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.last(f"__end_{n}", ignorenulls=True).over(earlier).alias(f"__before_{n}") for n in headers]
    # one row a split: lines carry its number, not the name of their file
    splits = lines.select("file", "block").distinct().join(ends, ["file", "block"], "left").select("file", "block", *before, F.dense_rank().over(Window.orderBy("file")).alias("file_no"), F.row_number().over(Window.orderBy("file", "block")).alias("__split"))
    told = marked.join(F.broadcast(splits.drop("file_no")), ["file", "block"]).drop("file", "block")
    # lines come in the order of their split, so a header is carried on as they stream by; they are not shuffled
    names = list(headers)
    carried = told.mapInArrow(lambda batches: _carried_on(batches, names), told.drop(*(f"__before_{n}" for n in names)).schema)
    return carried.join(F.broadcast(splits.select("file", "block", "file_no", "__split")), "__split").select(*lines.columns, *headers, "file_no")


def _carried_on(batches, names: list[str]):
    """The batches with nulls of the columns ``names`` replaced by the last value before them in their split, or what stood before the split (``__before_...``)."""
    split, last = None, {}
    for batch in batches:
        ends = pc.run_end_encode(batch["__split"]).run_ends.to_pylist()
        parts = {n: [] for n in names}
        for begin, end in zip([0, *ends], ends):
            now = batch["__split"][begin].as_py()
            if now != split:
                split, last = now, {n: batch[f"__before_{n}"][begin] for n in names}
            for n in names:
                part = pc.fill_null(pc.fill_null_forward(batch[n].slice(begin, end - begin)), last[n])
                last[n] = part[-1]
                parts[n].append(part)
        kept = [c for c in batch.schema.names if not c.startswith("__before_")]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(parts[c]) if parts.get(c) else batch[c] for c in kept], names=kept)


def _header(prefix: str) -> Column:
    return F.when(F.col("value").startswith(prefix), F.trim(F.substring(F.col("value"), F.lit(len(prefix) + 1), F.length("value"))))


def _fields(*names: tuple[str, str]) -> list[Column]:
    parts = F.split("value", "\t")
    return [F.get(parts, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(names)]


def _timed_rows(lines: DataFrame, *more: str) -> DataFrame:
    """The columns ``more``, file_no, block, line_id and the fields of the word lines, each with its speaker."""
    rows = spread(lines, speaker=_header("Speaker:")).filter(F.col("value").contains("\t"))
    return rows.select(*more, "file_no", "block", "line_id", "speaker", *_fields(("ref", "string"), ("start", "double"), ("end", "double"), ("word", "string"), ("pos_tag", "string"), ("tag", "string")))


#: A speaker's words within a file, and their order.
LINE, WITHIN = ["speaker", "file_no"], ["block", "line_id"]


def timed_corpus(spark: SparkSession, path: str, limit: bool = True) -> DataFrame:
    """speaker, pos, ref, start, end, word, pos_tag, tag from files with ``Speaker:`` headers and six tab-separated fields. With
    ``limit`` a word starts at most 0.3 s before its end."""
    named = _timed_rows(numbered_lines(spark, path))
    start = F.greatest("start", F.col("end") - MAX_WORD_S) if limit else F.col("start")
    at = F.row_number().over(Window.partitionBy(*LINE).orderBy(*WITHIN)) - 1
    return named.select("speaker", at.alias("pos"), "ref", start.alias("start"), "end", "word", "pos_tag", "tag")


def timed_words(spark: SparkSession, path: str) -> DataFrame:
    """word of the word lines of a timed corpus, for counts that need no speakers."""
    return spark.read.text(path).filter(F.col("value").contains("\t")).select(*_fields(("ref", "string"), ("start", "double"), ("end", "double"), ("word", "string"))).select("word")


def increco(spark: SparkSession, path: str) -> DataFrame:
    """speaker, update_no, update_time, pos_in_update, start, end, word, pos_tag, tag from update logs (``Speaker:`` or ``File:`` and ``Time:`` headers).
    Of ``gold@hyp`` values the hypothesis is taken."""
    lines = spread(numbered_lines(spark, path), speaker=F.coalesce(_header("Speaker:"), _header("File:")), time=_header("Time:").cast("double")).withColumn("is_time", F.col("value").startswith("Time:").cast("int"))
    lines = lines.withColumn("update_no", F.sum("is_time").over(Window.partitionBy("file", "speaker").orderBy("block", "line_id")) - 1)
    rows = lines.filter(F.col("value").contains("\t")).select("file", "block", "line_id", "speaker", F.greatest("update_no", F.lit(0)).alias("update_no"), F.col("time").alias("update_time"), *_fields(("start", "double"), ("end", "double"), ("word", "string"), ("pos_tag", "string"), ("tag", "string")))
    right = lambda c: F.element_at(F.split(c, "@"), -1).alias(c)
    at = F.row_number().over(Window.partitionBy("file", "speaker", "update_no").orderBy("block", "line_id")) - 1
    return rows.select("speaker", "update_no", "update_time", at.alias("pos_in_update"), "start", "end", right("word"), "pos_tag", right("tag"))


def final_hypothesis(spark: SparkSession, path: str) -> DataFrame:
    """The single block of a final-output file."""
    return increco(spark, path).filter("update_no = 0").select("speaker", F.col("pos_in_update").alias("pos"), "start", "end", "word", "pos_tag", "tag")


def detection_corpus(spark: SparkSession, path: str) -> DataFrame:
    """utt_ref, ref, word, pos_tag, tag; the utterance reference stands on an utterance's first row only."""
    rows = numbered_lines(spark, path).filter(F.col("value").contains("\t"))
    named = rows.select("file", "block", "line_id", *_fields(("own_ref", "string"), ("ref", "string"), ("word", "string"), ("pos_tag", "string"), ("tag", "string")))
    return spread(named, utt_ref=F.when(F.col("own_ref") != "", F.col("own_ref"))).select("utt_ref", "ref", "word", "pos_tag", "tag")


def easy_read(spark: SparkSession, path: str) -> DataFrame:
    """utt_ref, words, tags, pos_tags, refs from triples of lines: tagged words, POS tags, references."""
    lines = numbered_lines(spark, path).filter("value <> ''")
    first, rest = F.regexp_extract("value", "^([^,]*),", 1), F.regexp_replace("value", "^[^,]*,", "")
    is_head = ~first.isin("POS", "REF")
    lines = spread(lines, unit=F.when(is_head, F.col("line_id")))
    rows = lines.select("file", "unit", first.alias("kind"), F.split(rest, " ").alias("items"), is_head.alias("head"))
    pick = lambda c: F.first(F.when(c, F.col("items")), ignorenulls=True)
    out = rows.groupBy("file", "unit").agg(F.first(F.when(F.col("head"), F.col("kind")), ignorenulls=True).alias("utt_ref"), pick(F.col("head")).alias("tokens"), pick(F.col("kind") == "POS").alias("pos_tags"), pick(F.col("kind") == "REF").alias("refs"))
    split = lambda g: F.transform("tokens", lambda t: F.regexp_extract(t, "^(.*>)?([^>]*)$", g))
    return out.select("utt_ref", split(2).alias("words"), F.transform(split(1), lambda t: F.regexp_replace(t, "_", " ")).alias("tags"), "pos_tags", "refs")


def lm_corpus(spark: SparkSession, path: str) -> DataFrame:
    """conv, caller, utt, act, tokens, pos_tags from pairs of lines."""
    lines = numbered_lines(spark, path).filter("value <> ''")
    is_pos = F.col("value").startswith("POS,")
    lines = spread(lines, unit=F.when(~is_pos, F.col("line_id")))
    pairs = lines.groupBy("file", "unit").agg(F.first(F.when(~is_pos, F.col("value")), ignorenulls=True).alias("value"), F.first(F.when(is_pos, F.col("value")), ignorenulls=True).alias("pos_line"))
    ref = F.split(F.regexp_extract("value", "^([^,]*),", 1), ":")
    body = lambda c: F.split(F.regexp_replace(c, "^[^,]*,", ""), " ")
    rows = pairs.filter("value is not null")
    return rows.select(F.get(ref, F.lit(0)).alias("conv"), F.get(ref, F.lit(1)).alias("caller"), F.get(ref, F.lit(2)).cast("int").alias("utt"), F.get(ref, F.lit(3)).alias("act"), body("value").alias("tokens"), F.when(F.col("pos_line").isNotNull(), body("pos_line")).alias("pos_tags"))


def in_ranges(df: DataFrame, ranges: DataFrame, column: str = "conv") -> DataFrame:
    """Rows of the conversations listed in ``ranges(conv)``."""
    return df.join(ranges.select(F.col("conv").alias(column)).distinct(), column, "left_semi")


def division(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("conv")).filter("conv <> ''")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """idx, token; a token may hold commas."""
    return spark.read.text(path).filter("value <> ''").select(F.regexp_extract("value", "^([0-9]+),", 1).cast("int").alias("idx"), F.regexp_replace("value", "^[0-9]+,", "").alias("token"))


def repair_annotations(spark: SparkSession, path: str) -> DataFrame:
    """conv, four (utt, word) places and type from eleven tab-separated fields; rows that do not fit have ``ok`` false."""
    p = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    place = lambda i: F.struct(F.get(p, F.lit(i)).try_cast("int").alias("utt"), F.get(p, F.lit(i + 1)).try_cast("int").alias("word"))
    rows = spark.read.text(path).filter("value <> ''").select(F.get(p, F.lit(0)).alias("conv"), place(1).alias("reparandum"), place(3).alias("interregnum"), place(5).alias("repair"), place(7).alias("continuation"), F.get(p, F.lit(10)).alias("type"), F.size(p).alias("n"))
    return rows.withColumn("ok", (F.col("n") == 11) & F.col("reparandum.utt").isNotNull() & F.col("repair.utt").isNotNull()).drop("n")


def relaxed_annotations(spark: SparkSession, path: str) -> DataFrame:
    """conv, utt, k (1 .. the annotated number) from comma-separated rows of conversation, utterance and number."""
    p = F.split(F.regexp_replace("value", "\r$", ""), ",")
    rows = spark.read.text(path).select(F.trim(F.get(p, F.lit(2))).alias("conv"), F.get(p, F.lit(3)).try_cast("int").alias("utt"), F.get(p, F.lit(8)).try_cast("int").alias("n"))
    return rows.filter("utt is not null and n > 0").select("conv", "utt", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))


TRANSCRIPT = "swda_filename string, ptb_basename string, conversation_no string, transcript_index int, act_tag string, caller string, utterance_index int, subutterance_index int, text string, pos string, trees string, ptb_treenumbers string"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of transcript files; continued fragments (acts with ``@``) are left out, multi-valued fields are arrays."""
    rows = spark.read.csv(path, header=True, schema=TRANSCRIPT, multiLine=True, escape='"')
    many = lambda c: F.when(F.col(c) != "", F.split(c, r"\|\|\|")).otherwise(F.array().cast("array<string>")).alias(c)
    kept = rows.filter(~F.coalesce(F.col("act_tag").contains("@"), F.lit(False)))
    return kept.select(*(many(c) if c in ("trees", "ptb_treenumbers") else F.col(c) for c in kept.columns))


def with_metadata(utterances: DataFrame, metadata: DataFrame) -> DataFrame:
    """Utterances with their conversation's metadata, and the caller's own columns: ``from_*`` for caller A, ``to_*`` for B."""
    own = [c[5:] for c in metadata.columns if c.startswith("from_") and f"to_{c[5:]}" in metadata.columns]
    out = utterances.join(metadata, "conversation_no", "left")
    return out.select("*", *(F.when(F.col("caller") == "A", F.col(f"from_{c}")).otherwise(F.col(f"to_{c}")).alias(f"caller_{c}") for c in own))


FRAMES = "frame int, t double, rms double, log_energy double, f0 double, voicing double, f0_raw double, intensity double, loudness double"


def acoustic_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True, schema=FRAMES)


def frame_window(words: DataFrame, frames: DataFrame, value: str, by: list[str], n_frames: int = 50, frames_per_s: int = 100) -> DataFrame:
    """``words(by, pos, end)`` with the ``n_frames`` values up to each word's end, left-padded with zeros. Frames are numbered from 0 for each ``by``; frames of ``n_frames`` numbers and of those before them are one row, so a word meets one
    row and is shuffled once."""
    last = F.floor(F.round(F.col("end") * frames_per_s, 6)).cast("int")
    block = lambda c: F.floor(c / n_frames)
    # the values of a number, as an array: it may be missing or be there twice
    at = frames.groupBy(*by, "frame").agg(F.array_sort(F.collect_list(F.coalesce(value, F.lit(0.0)))).alias("v")).select("*", F.explode(F.array(block(F.col("frame")), block(F.col("frame")) + 1)).alias("__block"))
    place = (F.col("frame") - (F.col("__block") - 1) * n_frames).cast("int")
    blocks = at.groupBy(*by, "__block").agg(F.map_from_entries(F.collect_list(F.struct(place, "v"))).alias("__of"))
    nothing = F.array(F.lit(0.0))
    blocks = blocks.select(*by, "__block", F.transform(F.sequence(F.lit(0), F.lit(2 * n_frames - 1)), lambda i: F.coalesce(F.element_at("__of", i), nothing)).alias("__values"))
    got = words.select(*by, "pos", last.alias("__last"), block(last).alias("__block")).filter("__last is not null").join(blocks, [*by, "__block"], "left")
    window = F.slice("__values", F.col("__last") - F.col("__block").cast("int") * n_frames + 2, n_frames)
    return got.select(*by, "pos", F.coalesce(F.flatten(window), F.array_repeat(F.lit(0.0), n_frames)).alias(f"{value}_window"))


def c5_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per word of ``<s><w c5=TAG>word</w>...</s>`` lines: sentence, pos (C5), word."""
    lines = numbered_lines(spark, path).filter(F.col("value").contains("<w "))
    find = lambda g: F.regexp_extract_all("value", F.lit('<w [^>]*c5="([^"]+)"[^>]*>([^<]*)</w>'), F.lit(g))
    return lines.select("file", "line_id", F.posexplode(F.arrays_zip(find(1).alias("pos"), find(2).alias("word"))).alias("at", "w")).select("file", "line_id", "at", F.col("w.pos").alias("pos"), F.trim("w.word").alias("word"))


def textgrid(spark: SparkSession, path: str) -> DataFrame:
    """file, tier, start, end, text of the intervals of TextGrid files; silence has an empty text."""
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value"))
    field = lambda name: F.when(F.col("value").startswith(f"{name} = "), F.trim(F.regexp_replace("value", f'^{name} = |"', "")))
    marked = spread(lines, tier=field("name"), start=field("xmin").cast("double"), end=field("xmax").cast("double"))
    return marked.filter(F.col("value").startswith("text = ")).select(F.element_at(F.split("file", "/"), -1).alias("file"), "tier", "start", "end", field("text").alias("text"))


def bracketed(text: Column) -> Column:
    """Words and tags of bracket notation ``( reparandum + {F filler } repair )``: depths are running counts of the brackets. An array of
    (word, tag) structs, with repairs numbered from the left."""
    tokens = F.filter(F.split(F.regexp_replace(text, r"([()+{}])", " $1 "), r"\s+"), lambda t: t != "")
    start = F.struct(F.array().cast("array<struct<word:string,tag:string>>").alias("out"), F.lit(0).alias("open"), F.lit(False).alias("repairing"), F.lit(False).alias("filler"), F.lit(0).alias("n"), F.lit(False).alias("first"), F.lit(False).alias("letter"))

    def step(a, t):
        opening, plus, closing = t == "(", t == "+", t == ")"
        brace, unbrace = t == "{", t == "}"
        word = ~(opening | plus | closing | brace | unbrace | a["letter"])
        ident = F.concat(F.lit(' id="'), a["n"].cast("string"), F.lit('"/>'))
        tag = (
            F.when(a["filler"] & (a["open"] > 0) & a["repairing"] & a["first"], F.concat(F.lit("<i"), ident, F.lit("<e/>")))
            .when(a["filler"], "<e/>")
            .when((a["open"] > 0) & ~a["repairing"], F.concat(F.when(a["first"], "<rms").otherwise("<rm"), ident))
            .when((a["open"] > 0) & a["repairing"], F.concat(F.when(a["first"], "<rps").otherwise("<rp"), ident))
            .otherwise("<f/>")
        )
        return F.struct(
            F.when(word, F.concat(a["out"], F.array(F.struct(t.alias("word"), tag.alias("tag"))))).otherwise(a["out"]).alias("out"),
            (a["open"] + opening.cast("int") - closing.cast("int")).alias("open"),
            F.when(plus, True).when(opening | closing, False).otherwise(a["repairing"]).alias("repairing"),
            F.when(brace, True).when(unbrace, False).otherwise(a["filler"]).alias("filler"),
            (a["n"] + opening.cast("int")).alias("n"),
            F.when(opening | plus, True).when(word & ~a["filler"], False).otherwise(a["first"]).alias("first"),
            brace.alias("letter"),
        )

    return F.aggregate(tokens, start, step, lambda a: a["out"])


ASR = T.StructType([T.StructField("result_index", T.IntegerType()), T.StructField("results", T.ArrayType(T.StructType([T.StructField("alternatives", T.ArrayType(T.StructType([T.StructField("timestamps", T.ArrayType(T.ArrayType(T.StringType())))])))])))])


def asr_messages(df: DataFrame, column: str = "value", key: list[str] | None = None) -> DataFrame:
    """Words of recogniser messages (JSON): key, result_index, at, word, start, end. Works on streams too."""
    m = df.withColumn("__m", F.from_json(column, ASR))
    stamps = F.get(F.get(F.col("__m.results"), F.lit(0))["alternatives"], F.lit(0))["timestamps"]
    rows = m.select(*(key or []), F.col("__m.result_index").alias("result_index"), F.posexplode(stamps).alias("at", "w"))
    return rows.select(*(key or []), "result_index", "at", F.get("w", F.lit(0)).alias("word"), F.get("w", F.lit(1)).cast("double").alias("start"), F.get("w", F.lit(2)).cast("double").alias("end"))


def transition_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(prev, next, n) from a matrix file: the first row names the next states, the first column the states before."""
    from palaver.operators.decoding import matrix_to_counts

    wide = spark.read.csv(path, header=True, sep=sep)
    first, *rest = wide.columns
    return matrix_to_counts(wide.select(F.col(first).alias("prev"), *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in rest)))


def channel_error_rates(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("value <> ''").select(F.get(p, F.lit(0)).alias("conv"), F.get(p, F.lit(1)).alias("caller"), F.get(p, F.lit(2)).cast("double").alias("wer"))


def learning_curve(spark: SparkSession, path: str) -> DataFrame:
    """Learning curves, long form: epoch, metric, value; marks such as ``*`` are dropped."""
    wide = spark.read.csv(path, header=True)
    first, *rest = wide.columns
    long = wide.select(F.col(first).alias("epoch"), *rest).unpivot("epoch", rest, "metric", "value")
    return long.select(F.regexp_extract("epoch", "([0-9]+)", 1).cast("int").alias("epoch"), "metric", F.regexp_replace("value", "[*]", "").try_cast("double").alias("value"))


def experiment_config(spark: SparkSession, path: str, experiment: str) -> dict[str, object]:
    """One row of a configuration table as typed values: numbers, truth values, None or text."""

    def typed(v):
        if v is None or v in ("", "None"):
            return None
        if v in ("True", "False"):
            return v == "True"
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    rows = spark.read.csv(path, header=True)
    found = rows.filter(F.lpad(F.col(rows.columns[0]), 3, "0") == F.lpad(F.lit(experiment), 3, "0")).first()
    if found is None:
        raise KeyError(experiment)
    return {k: typed(v) for k, v in found.asDict().items()}


def spelling_rules(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """(pattern, form) rules, in order; a small resource that becomes part of the plan."""
    lines = numbered_lines(spark, path).filter(F.col("value").contains("\t")).orderBy("file", "block", "line_id")
    return tuple(tuple(r["value"].split("\t")[:2]) for r in lines.collect())


def language_model_lines(spark: SparkSession, path: str, conversations: DataFrame) -> DataFrame:
    """conv, utt and line of the word lines (``conv:caller:utt:act,words``) of a clean corpus, for the rows of ``conversations(conv)`` only."""
    lines = spark.read.text(path).select(F.regexp_extract("value", "^([^:,]+):[^:,]*:([0-9]+)(?::[^,]*)?,(.*)$", 0).alias("all"), *(F.regexp_extract("value", "^([^:,]+):[^:,]*:([0-9]+)(?::[^,]*)?,(.*)$", i).alias(n) for i, n in ((1, "conv"), (2, "utt"), (3, "line"))))
    return lines.filter("all <> ''").select("conv", F.col("utt").cast("int").alias("utt"), "line").join(conversations.select("conv").distinct(), "conv", "left_semi")


PARTS = ("train", "heldout", "test")


def with_previous_word(rows: DataFrame, by: list[str], order: list[str], least_s: float = 0.01) -> DataFrame:
    """``rows(word, start, end)`` with ``previous_word`` (empty at the start). A first word of no length begins ``least_s`` before its end."""
    along = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(along) == 1
    fixed = F.when(first & (F.col("end") <= F.col("start")), F.greatest(F.lit(0.0), F.col("end") - F.lit(least_s))).otherwise(F.col("start"))
    return rows.withColumn("previous_word", F.coalesce(F.lag("word").over(along), F.lit(""))).withColumn("start", fixed)


def trio(spark: SparkSession, paths: dict[str, str], vocabulary: DataFrame) -> DataFrame:
    """The timed corpora of several parts in one table with ``part``, words paired with the one before and encoded with ``vocabulary(idx, token)``. The word
    before is the speaker's last one in the same file, so places and words before come of one sort."""
    from palaver.operators.joins import lookup

    lines = reduce(DataFrame.unionByName, (numbered_lines(spark, path).withColumn("part", F.lit(part)) for part, path in paths.items()))
    rows = _timed_rows(lines, "part")
    by = ["part", *LINE]
    placed = with_previous_word(rows.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*WITHIN)) - 1), by, WITHIN)
    return lookup(placed.select("speaker", "pos", "ref", "start", "end", "word", "pos_tag", "tag", "previous_word", "part"), vocabulary, "word")


def node_map(spark: SparkSession, path: str) -> DataFrame:
    """utt_ref and nodes (an array, null where a word has none) from lines ``utt_ref<TAB>node node -``."""
    parts = F.split("value", "\t")
    nodes = F.transform(F.filter(F.split(F.get(parts, F.lit(1)), " "), lambda n: n != ""), lambda n: F.when(n != "-", n))
    return spark.read.text(path).filter("value <> ''").select(F.get(parts, F.lit(0)).alias("utt_ref"), nodes.alias("nodes"))


def tree_map(spark: SparkSession, path: str) -> DataFrame:
    """utt_ref and nodes (for each word an array of tree and leaf) from lines ``utt_ref<TAB>tree:leaf,tree:leaf - tree:leaf``."""
    parts = F.split("value", "\t")
    node = lambda x: F.struct(F.get(F.split(x, ":"), F.lit(0)).cast("long").alias("tree"), F.get(F.split(x, ":"), F.lit(1)).cast("long").alias("leaf"))
    none = F.array().cast("array<struct<tree:bigint,leaf:bigint>>")
    nodes = F.transform(F.filter(F.split(F.get(parts, F.lit(1)), " "), lambda n: n != ""), lambda n: F.when(n == "-", none).otherwise(F.transform(F.split(n, ","), node)))
    return spark.read.text(path).filter("value <> ''").select(F.get(parts, F.lit(0)).alias("utt_ref"), nodes.alias("nodes"))


def with_node_map(utterances: DataFrame, nodes: DataFrame, length: str) -> DataFrame:
    """``utterances(utt_ref, ...)`` with their ``nodes``; null where there is no map or its length is not the utterance's."""
    found = utterances.join(nodes.select("utt_ref", "nodes"), "utt_ref", "left")
    return found.withColumn("nodes", F.when(F.size("nodes") == F.col(length), F.col("nodes")))


def language_model(spark: SparkSession, path: str) -> DataFrame:
    """A model table (order, context, word, num, den, nz) as ``writers.model`` leaves it."""
    return spark.read.parquet(path).select(F.col("order").cast("int").alias("order"), "context", "word", "num", "den", "nz")
