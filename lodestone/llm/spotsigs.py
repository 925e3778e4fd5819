"""SpotSigs fingerprints: chains of content words behind common-word anchors (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.common import constant, key_cuts, range_of

#: Anchors: common words of the four languages of the corpus.
ANCHORS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with "
    "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au avec ce dans de des elle en est et il la le les par pas pour que qui sur un une "
    "al como con de del el en es la las lo los no para por que se su un una y"
)
#: Content words of a chain.
CHAIN = 3


def signatures(text: Column, anchors: str = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures as hashes, never empty.

    A signature is an anchor and the next ``chain`` content words (words that are no
    anchor); the words are runs of letters and digits in lower case. A text without a
    whole chain has its words as signatures, one without words itself.
    """
    common = sorted(set(anchors.split()))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def spots(words: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(common), i)), lambda i: i.isNotNull())
        return F.struct(words.alias("words"), at.alias("at"), F.filter(words, lambda w: ~w.isin(common)).alias("content"))

    def chains(s: Column) -> Column:
        # Anchor k stands at place at[k], so that at[k] - k content words come before it.
        whole = F.filter(
            F.transform(s["at"], lambda i, k: F.when(
                i - k + chain <= F.size(s["content"]),
                F.xxhash64(F.get(s["words"], i), *[F.get(s["content"], i - k + c) for c in range(chain)]),
            )),
            lambda h: h.isNotNull(),
        )
        return F.struct(whole.alias("whole"), s["words"].alias("words"))

    def pick(s: Column) -> Column:
        return (
            F.when(F.size(s["whole"]) > 0, s["whole"])
            .when(F.size(s["words"]) > 0, F.transform(s["words"], lambda w: F.xxhash64(w)))
            .otherwise(F.array(F.xxhash64(text)))
        )

    return F.array_sort(F.array_distinct(_let(_let(_let(words, spots), chains), pick)))


def _let(value: Column, body) -> Column:
    """body(value), value being evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(signatures: Column) -> Column:
    """The set as text: hexadecimal hashes, ascending, joined by spaces."""
    return F.array_join(F.transform(signatures, F.hex), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both).cast("double")


def with_next(docs: DataFrame, key: str, carried: list[str], rows_per_range: int = 2000) -> DataFrame:
    """docs with next_<column> of the row next in descending ``key`` (after the last: the first).

    Rows are dealt by ranges of the key between quantiles. The last row of a range also
    goes to the range above as its last, the first of all also below the last, so that
    each range is complete in itself and the rows move once. Null keys are the least;
    equal keys go by the carried columns' hash.
    """
    cuts = key_cuts(docs, key, rows_per_range)
    # most: the greatest key, unless all are null
    most = docs.agg(F.max(key)).first()[0]
    at = range_of(F.col(key), cuts)
    own = F.struct(at.alias("range"), F.lit(False).alias("extra"))
    copies = F.array(own)
    if cuts:
        copies = F.when(F.coalesce((F.get(constant(cuts), at) == F.col(key)) & (F.col(key) < most), F.lit(False)), F.array(own, F.struct((at + 1).alias("range"), F.lit(True).alias("extra")))).otherwise(copies)
    wrap = F.array(F.struct(F.lit(0).alias("range"), F.lit(True).alias("extra")))
    last = F.lit(True) if most is None else F.col(key) == most
    copies = F.when(F.coalesce(last, F.lit(False)), F.concat(copies, wrap)).otherwise(copies)
    rows = docs.withColumn("copy", F.explode(copies)).select("*", "copy.*").drop("copy").withColumn("tie", F.xxhash64(*carried))
    order = W.partitionBy("range").orderBy("extra", F.col(key).desc_nulls_last(), "tie")
    for c in carried:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where("not extra").drop("range", "extra", "tie")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likenesses.

    The edited text has the last half of the code points (rounded down) replaced by the
    first as many, or all, of the next document, in descending order of id. A null text
    is empty; of an empty table nothing comes; a single row is next to itself; of rows
    with equal ids, each is next to another; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("s", signatures(F.col("text"))), "doc_id", ["text", "s"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "s", "next_s")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "s", "next_s", signatures(F.col("edited")).alias("e"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): class of each row by equal fingerprint, and links between classes.

    members: (doc_id, class_id), the class being its least id. links: (a, b, likeness)
    of classes, a < b, whose Jaccard likeness is ``threshold`` or more. Sets are
    partitioned by length, each partition being met by itself and the next shorter only;
    within one, sets meet by the rarest signatures that two such sets must share, and a
    pair whose lengths rule the likeness out is left before its sets are fetched.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), signatures(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    rows = rows.withColumn("print", F.sha2(fingerprint(F.col("s")), 256))
    firsts = rows.groupBy("print").agg(F.min("doc_id").alias("class_id"))
    members = rows.select("doc_id", "print").join(firsts, "print").select("doc_id", "class_id")
    sets = rows.dropDuplicates(["print"]).join(firsts, "print").select("class_id", "s")
    sig = sets.select("class_id", F.explode("s").alias("h"), F.size("s").alias("n"))
    rare = sig.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    own = F.size("s") - F.ceil(threshold * F.size("s") - 1e-9).cast("int") + 1
    # Signatures of one class only link nothing; they still count in the prefix.
    place = sig.join(rare, "h", "left").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "h"))).alias("s"))
    prefix = place.select("class_id", "n", F.posexplode(F.slice("s", F.lit(1), own)).alias("at", "x")).where("x.df > 1")
    step = math.log(1 / threshold) if threshold < 1 else 1e-9
    part = F.floor(F.log(F.col("n").cast("double")) / step)
    prefix = prefix.select("class_id", "n", "at", F.col("x.h").alias("h"), part.alias("part"))
    meets = prefix.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    x, y = meets.alias("x"), prefix.alias("y")
    # An element at place i of one and j of the other leaves this much at most in common.
    common = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    needed = threshold / (1 + threshold) * (F.col("x.n") + F.col("y.n")) - 1e-9
    shorter = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.class_id") < F.col("y.class_id")))
    pairs = x.join(y, ["part", "h"]).where(shorter & (F.col("x.n") >= threshold * F.col("y.n") - 1e-9) & (common >= needed))
    pairs = pairs.select(F.col("x.class_id").alias("p"), F.col("y.class_id").alias("q")).distinct()
    a, b = sets.select(F.col("class_id").alias("p"), F.col("s").alias("ps")), sets.select(F.col("class_id").alias("q"), F.col("s").alias("qs"))
    links = pairs.join(a, "p").join(b, "q").withColumn("likeness", likeness(F.col("ps"), F.col("qs"))).where(F.col("likeness") >= threshold)
    return members, links.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "likeness")
