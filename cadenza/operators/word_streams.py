"""Rewriting of streams of recognised words: split words, contractions, repeated letters, artefacts, overlaps, short words and notation.

Every step is window functions over a video's words in order. Where a match takes in the words behind it, matches that could overlap form a chain, which is
gone through from its left; chains are a few words long, and no step needs a video's words together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

# Prefixes of split words with the rest and the whole word, for the prefix as it stands.
SPLIT_WORDS = {
    "U": {"gh": "Ugh"}, "u": {"gh": "ugh"}, "A": {"h": "Ah", "w": "Aw"}, "a": {"h": "ah", "w": "aw"}, "O": {"h": "Oh", "k": "Ok", "kay": "Okay"}, "o": {"h": "oh", "k": "ok", "kay": "okay"},
    "Str": {"uggling": "Struggling", "ong": "Strong", "eet": "Street", "ategic": "Strategic", "ess": "Stress"},
    "str": {"uggling": "struggling", "ong": "strong", "eet": "street", "ategic": "strategic", "ess": "stress"},
    "hyd": {"rate": "hydrate", "rogen": "hydrogen", "ration": "hydration"}, "Hyd": {"rate": "Hydrate", "rogen": "Hydrogen", "ration": "Hydration"},
    "pro": {"duct": "product", "gram": "program", "cess": "process", "ductivity": "productivity"}, "Pro": {"duct": "Product", "gram": "Program", "cess": "Process", "ductivity": "Productivity"},
    "con": {"tent": "content", "trol": "control", "sider": "consider"}, "Con": {"tent": "Content", "trol": "Control", "sider": "Consider"},
    "at": {"risk": "at risk"}, "At": {"risk": "At risk"}, "Opt": {"imal": "Optimal"}, "opt": {"imal": "optimal"}, "mel": {"atonin": "melatonin"}, "Mel": {"atonin": "Melatonin"},
    "Mess": {"es": "Messes"}, "mess": {"es": "messes"}, "ch": {"ug": "chug"}, "Ch": {"ug": "Chug"}, "r": {"isk": "risk"}, "R": {"isk": "Risk"},
}
# Words that are often split behind a short capitalised beginning.
LIKELY_SPLIT = [
    "struggling", "strong", "street", "strategic", "hydrate", "hydrogen", "hydration", "product", "program", "process", "content", "control", "consider", "together", "different",
    "important", "something", "everything", "anything", "beautiful", "wonderful", "powerful", "successful",
]
# Endings of contractions, and the words of one and two letters that are no artefacts.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m"]
ONE_LETTER = ["a", "A", "i", "I", "o", "O"]
TWO_LETTERS = [
    "an", "as", "at", "be", "by", "do", "go", "he", "if", "in", "is", "it", "me", "my", "no", "of", "on", "or", "so", "to", "up", "us", "we", "am", "ok", "oh", "ah", "aw", "uh",
]
LEAST_MS = 50


def order() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("idx")


def first_matches(rows: DataFrame, length: Column) -> DataFrame:
    """``rows`` (video_id, idx) with ``taken``: how many words the match that begins here takes in, 1 for none, and null for a word inside a match.

    ``length`` says for each word how many words (1 to 3) a match that begins here would take in. From the left, the first match of overlapping ones counts.
    """
    rows = rows.withColumns({"_len": length, "_at": F.row_number().over(order())})
    reached = (F.coalesce(F.lag("_len", 1).over(order()), F.lit(1)) >= 2) | (F.coalesce(F.lag("_len", 2).over(order()), F.lit(1)) >= 3)
    # Only a chain's first word is out of reach of every earlier match.
    rows = rows.withColumn("_chain", F.sum(F.when(reached, 0).otherwise(1)).over(order()))
    chains = rows.groupBy("video_id", "_chain").agg(F.array_sort(F.collect_list(F.struct("_at", "_len"))).alias("_l"), F.collect_list(F.struct([F.col(f"`{c}`") for c in rows.columns if c not in ("video_id", "_chain")])).alias("_rows"))
    state = lambda free, begins: F.named_struct(F.lit("free"), free, F.lit("begins"), begins)
    start = state(F.lit(0), F.array().cast("array<int>"))

    def step(acc: Column, x: Column) -> Column:
        taken = state(x["_at"] + x["_len"], F.concat(acc["begins"], F.array(x["_at"])))
        return F.when(x["_at"] >= acc["free"], taken).otherwise(acc)

    begins = F.aggregate("_l", start, step, lambda acc: acc["begins"])
    spread = chains.select("video_id", begins.alias("_b"), F.explode("_rows").alias("_r")).select("video_id", "_b", "_r.*")
    return spread.withColumn("taken", F.when(F.array_contains("_b", F.col("_at")), F.col("_len"))).drop("_b", "_at", "_len")


def _known(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(1.0))


def join_split_words(words: DataFrame) -> DataFrame:
    """Words split by recognition put together: known pairs with their mean confidence, 0.8 at least; likely ones with the lower confidence."""
    following = lambda c: F.lead(c).over(order())
    rows = words.withColumns({"_next": following("word"), "_end": following("end_ms"), "_conf": following("confidence"), "_more": following("idx").isNotNull()})
    table = F.create_map(*[F.lit(x) for a, rest in SPLIT_WORDS.items() for b, whole in rest.items() for x in (f"{a} {b}", whole)])
    known = F.element_at(table, F.concat("word", F.lit(" "), F.lower("_next")))
    low = F.lower(F.concat("word", "_next"))
    likely = F.col("word").rlike("^[A-Z][a-z]{0,2}$") & F.col("_next").rlike("^[a-z]{4,}$") & low.isin(LIKELY_SPLIT)
    rows = rows.withColumns({"_known": known, "_likely": F.coalesce(likely, F.lit(False))})
    rows = first_matches(rows, F.when(F.col("_more") & (F.col("_known").isNotNull() | F.col("_likely")), 2).otherwise(1)).where("taken is not null")
    whole = F.coalesce("_known", F.concat(F.upper(F.left("word", F.lit(1))), F.lower(F.expr("substring(word, 2)")), F.lower("_next")))
    both = F.when(F.col("_known").isNotNull(), F.greatest((_known(F.col("confidence")) + _known(F.col("_conf"))) / 2, F.lit(0.8))).otherwise(F.least(_known(F.col("confidence")), _known(F.col("_conf"))))
    joined = F.col("taken") == 2
    return rows.select("video_id", "idx", F.when(joined, whole).otherwise(F.col("word")).alias("word"), "start_ms", F.when(joined, F.col("_end")).otherwise(F.col("end_ms")).alias("end_ms"), F.when(joined, both).otherwise(F.col("confidence")).alias("confidence"))


def join_contractions(words: DataFrame) -> DataFrame:
    """A word and the ending of a contraction behind it become one, with the lower confidence."""
    following = lambda c: F.lead(c).over(order())
    rows = words.withColumns({"_next": following("word"), "_end": following("end_ms"), "_conf": following("confidence")})
    rows = first_matches(rows, F.when(F.col("word").isNotNull() & F.col("_next").isin(CONTRACTIONS), 2).otherwise(1)).where("taken is not null")
    joined = F.col("taken") == 2
    return rows.select(
        "video_id", "idx", F.when(joined, F.concat("word", "_next")).otherwise(F.col("word")).alias("word"), "start_ms", F.when(joined, F.col("_end")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(joined, F.least(_known(F.col("confidence")), _known(F.col("_conf")))).otherwise(F.col("confidence")).alias("confidence"))


def join_letters(words: DataFrame) -> DataFrame:
    """Runs of one repeated letter become one word, with the lowest confidence."""
    rows = words.withColumn("_letter", F.when(F.col("word").rlike("^[a-zA-Z]$"), F.lower("word")))
    new = F.col("_letter").isNull() | ~F.col("_letter").eqNullSafe(F.lag("_letter").over(order()))
    rows = rows.withColumn("_run", F.sum(F.when(new, 1).otherwise(0)).over(order()))
    spelt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("word", F.lit("")).alias("w")))), lambda x: x["w"]), "")
    alone = F.count("*") == 1
    runs = rows.groupBy("video_id", "_run").agg(
        F.min("idx").alias("idx"), F.when(alone, F.min("word")).otherwise(spelt).alias("word"), F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"),
        F.when(alone, F.min("confidence")).otherwise(F.min(_known(F.col("confidence")))).alias("confidence"))
    return runs.select("video_id", "idx", "word", "start_ms", "end_ms", "confidence")


def is_artefact(word: Column) -> Column:
    """One or two letters that are no word."""
    text = F.trim(F.coalesce(word, F.lit("")))
    return (text.rlike("^[a-zA-Z]$") & ~text.isin(ONE_LETTER)) | (text.rlike("^[a-zA-Z]{2}$") & ~F.lower(text).isin(TWO_LETTERS))


def split_overlaps(words: DataFrame) -> DataFrame:
    """Neighbours that overlap meet in the middle between the first one's end and the second one's start."""
    start, end = F.col("start_ms").cast("double"), F.col("end_ms").cast("double")
    rows = words.withColumns({"_next": F.lead(start).over(order()), "_before": F.lag(end).over(order())})
    return rows.withColumns({
        "start_ms": F.when(start < F.col("_before"), (F.col("_before") + start) / 2).otherwise(start), "end_ms": F.when(F.col("_next") < end, (end + F.col("_next")) / 2).otherwise(end),
    }).drop("_next", "_before")


def lengthen_words(words: DataFrame, least_ms: float = LEAST_MS) -> DataFrame:
    """Words of less than ``least_ms`` last that long; what the gap behind them cannot give moves all later words on."""
    start, end = F.col("start_ms").cast("double"), F.col("end_ms").cast("double")
    lacks = F.greatest(F.lit(0.0), least_ms - (end - start))
    rows = words.withColumns({"_lacks": lacks, "_next": F.lead(start).over(order())})
    # A gap below zero adds to the shift, as the word behind overlapped already.
    over = F.when((F.col("_lacks") > 0) & F.col("_next").isNotNull(), F.greatest(F.lit(0.0), F.col("_lacks") - (F.col("_next") - end))).otherwise(0.0)
    shift = F.coalesce(F.sum(F.col("_over")).over(order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_over", over).withColumn("_shift", shift)
    return rows.withColumns({"start_ms": start + F.col("_shift"), "end_ms": end + F.col("_shift") + F.col("_lacks")}).drop("_lacks", "_next", "_over", "_shift")


def repaired_hearing(words: DataFrame, least_ms: float = LEAST_MS) -> DataFrame:
    """Recognised words (video_id, idx, word, start_ms, end_ms, confidence) after all repairs, in this order: split words, contractions, repeated letters, artefacts out,
    overlaps, short words. ``idx`` is that of a word's first part; times are doubles.

    Null words match nothing and stay; an unknown confidence counts as 1 where words are joined. ``idx`` must be unique within a video. Words with null times stay as they are.
    """
    rows = join_letters(join_contractions(join_split_words(words.select("video_id", "idx", "word", "start_ms", "end_ms", "confidence"))))
    return lengthen_words(split_overlaps(rows.where(~is_artefact(F.col("word")))), least_ms)


# Signs that are told apart by recognition and belong together, of two words and of three.
SIGNS = {("-", ">"): "->", ("<", "="): "<=", (">", "="): ">=", ("!", "="): "!="}


def join_notation(words: DataFrame) -> DataFrame:
    """Words of a formula put together: ``sqrt (``, powers and indices (``x ^ 2``, ``x _ 2``), ``< - >`` and signs of two characters.

    Input and output: video_id, idx, word, start_ms, end_ms. A joined word ends with its last part. Null words join nothing.
    """
    a = F.col("word")
    rows = words.select("video_id", "idx", "word", "start_ms", "end_ms", *[F.lead(c, k).over(order()).alias(f"_{n}{k}") for c, n in (("word", "w"), ("end_ms", "e")) for k in (1, 2)])
    b, c = F.col("_w1"), F.col("_w2")
    both = a.rlike("^[a-zA-Z0-9]+$") & c.rlike("^[a-zA-Z0-9]+$")
    root = (F.lower(a) == "sqrt") & (b == "(")
    power = b.isin("^", "_") & both
    arrow = (a == "<") & (b == "-") & (c == ">")
    sign = F.element_at(F.create_map(*[F.lit(x) for (x0, x1), s in SIGNS.items() for x in (f"{x0} {x1}", s)]), F.concat(a, F.lit(" "), b))
    known = lambda x: F.coalesce(x, F.lit(False))
    whole = F.when(known(root), "sqrt(").when(known(power), F.concat(a, b, c)).when(known(arrow), "<->").otherwise(sign)
    length = F.when(known(root), 2).when(known(power) | known(arrow), 3).when(sign.isNotNull(), 2).otherwise(1)
    rows = first_matches(rows.withColumn("_whole", whole), length).where("taken is not null")
    end = F.when(F.col("taken") == 3, F.col("_e2")).when(F.col("taken") == 2, F.col("_e1")).otherwise(F.col("end_ms"))
    return rows.select("video_id", "idx", F.when(F.col("taken") > 1, F.col("_whole")).otherwise(a).alias("word"), "start_ms", end.alias("end_ms"))
