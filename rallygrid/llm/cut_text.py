"""Texts cut off by field limits or in transfer.

Two tests, each under false-discovery control (Benjamini-Hochberg), meet.

*Lengths*: per source, the discrete hazard of ending at length L (texts that end there over texts
that reach it) is held against the hazards of the neighbouring lengths; a Chernoff bound gives a
p-value that errs on the safe side. A significant length is a field limit or a natural length.
*Endings*: the segment after the last sentence border is complete if it ends like a sentence, is a
closed bracket, or is a sign-off. A form of ending is a sign-off when more distinct texts of its
source (or of the corpus) end in it than cuts could bring about: cuts are spread over very many
forms, so each has at most the share ``background`` of the texts, and the same bound and procedure
tell which forms exceed it. Texts at significant lengths are left out of this count, as a
limit would make one form of cut recur.

At a significant length the hazards carry the decision: every incomplete ending there is flagged,
and a doubtful one - a number and a stop, which may be half of a decimal - is incomplete already
if ``LIMIT_SHARE`` of such numbers inside texts go on as decimals. Elsewhere, where only a cut in
transfer is possible, an ending is flagged when it is no sign-off, and a doubtful one only if
such numbers are decimals more often than not.

Copies of a text, told by its last ``TAIL`` characters, are one text in all statistics, however
often they are posted; all rows are judged. (In a source of a handful of sentences put together
over and over, a cut form may recur like a sign-off and pass as one.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallygrid.session import broadcast_if_small, cut_lineage

FDR = 0.01
NEIGHBOURS = 60
BACKGROUND = 0.002
LIMIT_SHARE = 0.05
TAIL = 160

_CLOSERS = r"""["'”’»)\]]*"""
#: The last segment in a reversed text: up to its first border, or all of it.
_LAST = r"(?s)^(.*?)(?:\s+" + _CLOSERS + r"[.!?…。！？]|\s*[\r\n]|$)"
_ENDS = r"[.!?。！？]" + _CLOSERS + "$"
#: Marks of omission, as fixed values: dots, and bracketed notes of a continuation.
_OMISSION = (
    r"(?i)(?:\.\.+|…|\[\s*(?:\.\.+|…)\s*\]|\(\s*(?:\.\.+|…)\s*\)"
    r"|[(\[]\s*(?:cont|cont'd|continued|more|truncated|cut|read more)\.?\s*[)\]]?|\x{FFFD}+)$"
)
_NUMBER_END = r"(\S+\s+\S*\d\.)" + _CLOSERS + "$"
#: The same inside a reversed text, behind a digit or behind white space (group 1, without the stop).
_DECIMALS = r"\d\.(?=(\d\S*\s+\S+))"
_STOPS = r"\s" + _CLOSERS + r"\.(?=(\d\S*\s+\S+))"


def _backwards(text: Column) -> Column:
    """The text reversed, without the blanks at its end: what matters stands first, so that
    patterns needn't cross the whole text to reach it."""
    return F.regexp_replace(F.reverse(text), r"(?U)^\s+", "")


def masked(segment: Column) -> Column:
    """A segment without what varies in a sign-off: numbers, scores, names of tags."""
    out = F.regexp_replace(F.lower(segment), r"#[\p{L}\p{N}_]+", "#a")
    out = F.regexp_replace(out, r"\[?\d+-\d+\]?(?:\(\d+\))?", "S")
    out = F.regexp_replace(out, r"S(?:\s+S)+", "S")
    return F.regexp_replace(out, r"\d+", "9")


def _tail_digest(backwards: Column) -> Column:
    return F.xxhash64(F.substring(F.lower(backwards), 1, TAIL))


def _number_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\d+", "9")


def _chernoff(n: Column, expected: Column) -> Column:
    """A bound on the chance of a Poisson count of at least ``n``."""
    return F.when(n > expected, F.exp(n - expected - n * F.log(n / expected))).otherwise(F.lit(1.0))


def _discoveries(tests: DataFrame, fdr: float, m: int) -> DataFrame:
    """Rows of ``tests`` (with ``p_value``) that the Benjamini-Hochberg procedure keeps among ``m``
    tests; rows not given must have larger p-values. The border is found on one row per distinct
    p-value under ``fdr``: a value above is never kept, and those below come first in order."""
    few = tests.filter(F.col("p_value") <= fdr).groupBy("p_value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("p_value").rowsBetween(Window.unboundedPreceding, 0))
    kept = few.withColumn("k", upto).filter(F.col("p_value") <= F.col("k") * F.lit(fdr / max(m, 1)))
    border = kept.agg(F.max("p_value").alias("border"))
    return tests.join(F.broadcast(border), F.col("p_value") <= F.col("border")).drop("border")  # one row


def significant_lengths(docs: DataFrame, fdr: float = FDR, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``source, length, n, expected, p_value`` of the lengths at which a source ends texts
    significantly more often than at the neighbouring lengths. ``docs``: ``source, length``.

    Works on counts per (source, length), never on rows of one source in a task."""
    counts = docs.groupBy("source", "length").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy("source").orderBy(F.col("length").desc())
    near = Window.partitionBy("source").orderBy("length").rangeBetween(-neighbours, neighbours)
    tests = (
        counts.withColumn("reach", F.sum("n").over(by_length))
        .withColumn("others", F.sum("n").over(near) - F.col("n"))
        .withColumn("mean_reach", F.avg("reach").over(near))
        .withColumn("exposure", F.lit(2.0 * neighbours) * F.col("mean_reach"))
        .withColumn("expected", F.col("reach") * F.greatest(F.col("others"), F.lit(0.5)) / F.col("exposure"))
        .withColumn("p_value", _chernoff(F.col("n"), F.col("expected")))
        .select("source", "length", "n", "expected", "p_value")
    )
    tests = cut_lineage(tests)
    return _discoveries(tests, fdr, tests.count())


def _sign_offs(texts: DataFrame, background: float, fdr: float) -> DataFrame:
    """``src, sig`` of the forms that more texts of the source - or of the corpus, then with a null
    ``src`` - end in than cuts could bring about. ``texts``: ``src, sig`` (null for other endings), a row per
    distinct text. A kept form has more than ``background`` of the texts, so there are few."""
    counts = texts.groupBy("src", "sig").agg(F.count("*").alias("n"))
    scopes = counts.select(F.explode(F.array(F.col("src"), F.lit(None).cast("string"))).alias("src"), "sig", "n")
    forms = cut_lineage(scopes.groupBy("src", "sig").agg(F.sum("n").alias("n")))
    sizes = forms.groupBy(F.col("src").alias("of")).agg(F.sum("n").alias("size"), F.count("sig").alias("forms"))  # a row per source
    sized = forms.filter("sig is not null and n > 1").join(F.broadcast(sizes), F.col("src").eqNullSafe(F.col("of")))
    tests = sized.withColumn("p_value", _chernoff(F.col("n").cast("double"), F.lit(background) * F.col("size")))
    return _discoveries(tests.select("src", "sig", "p_value"), fdr, forms.filter("sig is not null").count()).select("src", "sig")


def judge_endings(documents: DataFrame, fdr: float = FDR, background: float = BACKGROUND) -> DataFrame:
    """``doc_id, source, length, cut boolean, at_limit boolean``, one row per text row.

    ``documents``: ``doc_id, text, source``; other columns are ignored. A null source is a
    source of its own. Null, empty and blank texts have no ending and count as whole. Repeated
    rows are judged alike and count once in the statistics; an empty table gives no rows. Texts
    of any length are read whole. The sources must be few enough for a table of them to be sent.
    """
    back = _backwards(F.coalesce("text", F.lit("")))
    docs = documents.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("src"), F.col("source"))
    docs = docs.withColumn("back", back).withColumn("segment", F.reverse(F.regexp_extract("back", _LAST, 1)))
    closed = F.col("segment").rlike(r"(?s)(?:^|\s)[(\[][^()\[\]]*\p{L}[^()\[\]]*[)\]]$")
    omission = F.col("segment").rlike(_OMISSION)
    sentence = F.col("segment").rlike(_ENDS) & ~omission
    form = (
        F.when(F.col("back") == "", "none")
        .when(sentence & F.col("segment").rlike(r"\d\." + _CLOSERS + "$"), "number")
        .when(sentence, "sentence")
        .when(closed & ~omission, "closed")
        .otherwise("open")
    )
    narrow = cut_lineage(
        docs.withColumn("form", form).select(
            "doc_id",
            "source",
            "src",
            F.coalesce(F.length("text"), F.lit(0)).alias("length"),
            _tail_digest(F.col("back")).alias("digest"),
            "form",
            F.when(F.col("form") == "open", masked(F.col("segment"))).alias("sig"),
            F.when(F.col("form") == "number", _number_key(F.regexp_extract("segment", _NUMBER_END, 1))).alias("number"),
        )
    )
    # Copies under new ids say nothing about habits: only distinct texts are learned from.
    texts = cut_lineage(narrow.filter("form <> 'none'").select("src", "digest", "length", "sig").distinct())
    limits = cut_lineage(significant_lengths(texts.select(F.col("src").alias("source"), "length"), fdr))
    spikes, _ = broadcast_if_small(limits.select(F.col("source").alias("src"), "length", F.lit(True).alias("limit")))

    free = texts.join(spikes, ["src", "length"], "left_anti").groupBy("src", "digest").agg(F.max("sig").alias("sig"))
    sign_offs = cut_lineage(_sign_offs(free, background, fdr))
    in_source = sign_offs.filter("src is not null").withColumn("habit", F.lit(True))
    in_corpus = sign_offs.filter("src is null").select("sig", F.lit(True).alias("custom"))

    # What follows such numbers inside texts: white space (the end of a sentence) or a digit.
    asked = narrow.filter("form = 'number' and number <> ''").select("number").distinct()
    def seen(pattern: str, decimal: float) -> Column:
        keys = F.array_distinct(F.regexp_extract_all("back", F.lit(pattern), F.lit(1)))
        return F.transform(keys, lambda x: F.struct(x.alias("x"), F.lit(decimal).alias("decimal")))

    supported = (
        documents.filter("text is not null")
        .select(_backwards(F.col("text")).alias("back"))
        .select(_tail_digest(F.col("back")).alias("digest"), F.explode(F.concat(seen(_DECIMALS, 1.0), seen(_STOPS, 0.0))).alias("k"))
        .select(F.concat(_number_key(F.reverse("k.x")), F.lit(".")).alias("number"), "k.decimal", "digest")
        .join(asked, "number", "left_semi")
        .distinct()
        .groupBy("number")
        .agg(F.avg("decimal").alias("decimals"))
    )

    # A sign-off may also follow a passage that has no stop of its own; bare numbers may not.
    told = ~F.col("sig").rlike(r"^[S9\s.,:-]*$")
    closings, _ = broadcast_if_small(in_source.filter(told).groupBy("src").agg(F.collect_set("sig").alias("closings")))
    _, small = broadcast_if_small(sign_offs)
    habits, customs = (F.broadcast(x) if small else x for x in (in_source, in_corpus))
    supports, _ = broadcast_if_small(cut_lineage(supported))
    joined = (
        narrow.join(habits, ["src", "sig"], "left")
        .join(customs, "sig", "left")
        .join(closings, "src", "left")
        .join(supports, "number", "left")
        .join(spikes, ["src", "length"], "left")
    )
    at_limit = F.coalesce("limit", F.lit(False))
    follows = F.exists("closings", lambda c: F.endswith(F.col("sig"), F.concat(F.lit(" "), c)))
    known = F.coalesce("habit", "custom", follows, F.lit(False))
    doubtful = F.coalesce("decimals", F.lit(1.0)) >= F.when(at_limit, LIMIT_SHARE).otherwise(0.5)
    cut = F.when(F.col("form") == "open", ~known).when(
        (F.col("form") == "number") & (F.col("number") != ""), doubtful
    ).otherwise(F.lit(False))
    return joined.select("doc_id", "source", "length", cut.alias("cut"), at_limit.alias("at_limit"))


def cut_rates(judged: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, cut texts at a significant length, and the rate."""
    return judged.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.col("cut").cast("long")).alias("n_cut"),
        F.sum((F.col("cut") & F.col("at_limit")).cast("long")).alias("n_cut_at_limit"),
        F.avg(F.col("cut").cast("double")).alias("cut_rate"),
    )
