"""Secret scans: fixed rules plus character Markov models, in built-in functions only.

``scan`` adds to every row the spans of four kinds. ``assign``, ``access`` and
``hex`` are fixed patterns. ``markov`` spans are runs of token characters whose
log-likelihood ratio between two first-order character models, one of random
strings and one of ordinary identifiers, is high. A run is judged whole, also
where a rule has found a part of it; one that a rule's span covers adds nothing.

Cases: a null or empty text has no span; a very long text is scanned whole, as
one row; overlapping kinds are all reported, those of one start in the order of
their kinds; repeated rows each get their own result; an empty table gives no
rows; extra columns pass through unless
they carry one of the result's names, which the result replaces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules' patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a maximal run, so 20 characters and more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A run is a secret if the mean log-likelihood ratio of a character pair reaches this.
LEAST_MEAN_LLR = 0.35
#: Labelled strings drawn for each of the two models (the documented bound of the sample).
SAMPLE = 1000

#: Words from which the labelled ordinary identifiers are put together.
ORDINARY = (
    "the and for with from that this have which their about other after first people between under "
    "against because number system public general world state country order service process account "
    "client server request response handler controller manager factory builder parser token message "
    "buffer stream reader writer string integer boolean object array value index count total result "
    "default option config setting property attribute element document report customer product "
    "invoice payment address street city region national international development government "
    "education information communication organisation administration understanding relationship "
    "although through throughout everything something nothing without within together another "
    "creation station nation motion action question answering running standing thinking "
    "haben werden nicht eine einer und der die das mit auch nach heit keit lich schaft zwischen "
    "ungen geben verstehen arbeit zeit gesellschaft entwicklung "
    "pour dans avec leur mais comme tout plus faire entre toujours gouvernement maintenant "
    "mente para como pero entre cuando todos nosotros gobierno desarrollo trabajo tiempo ciudad"
).split()


def labelled_samples(spark: SparkSession, size: int = SAMPLE) -> DataFrame:
    """(text, label): ``random`` strings of four alphabets and ``ordinary`` identifiers, by rule."""
    ids = spark.range(size)
    digest = F.sha2(F.col("id").cast("string"), 512)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), r"[\r\n]", "")
    random = ids.select(F.explode(F.array(digest, F.upper(digest), coded, F.translate(F.upper(coded), "+/=", "738"))).alias("text"), F.lit("random").alias("label"))
    words = F.split(F.lit(" ".join(ORDINARY)), " ")
    parts = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), k), F.lit(len(ORDINARY))) + 1).cast("int")))
    camel = F.array_join(F.transform(parts, lambda w: F.initcap(w)), "")
    ordinary = ids.select(
        F.explode(F.array(F.array_join(parts, "_"), F.array_join(parts, "-"), F.array_join(parts, ""), camel, F.upper(F.array_join(parts, "_")))).alias("text"),
        F.lit("ordinary").alias("label"),
    )
    return random.unionByName(ordinary)


def train(samples: DataFrame) -> list[float]:
    """The table of log-likelihood ratios, ``len(ALPHABET) ** 2`` of them, add-half smoothed.

    The only result that reaches the driver is one count for each pair of the
    alphabet and label, at most 2 * 67 * 67 rows.
    """
    at = F.sequence(F.lit(1), F.length("text") - 1)
    pairs = samples.where(F.length("text") > 1).select("label", F.explode(F.transform(at, lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["count"] for r in pairs.groupBy("label", "pair").count().collect()}
    table = []
    for a in ALPHABET:
        total = {k: sum(counts.get((k, a + b), 0) + 0.5 for b in ALPHABET) for k in ("random", "ordinary")}
        for b in ALPHABET:
            table.append(math.log((counts.get(("random", a + b), 0) + 0.5) / total["random"]) - math.log((counts.get(("ordinary", a + b), 0) + 0.5) / total["ordinary"]))
    return table


def mean_llr(run: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of the character pairs of ``run``, which is over ALPHABET."""
    ratios, n = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>"), len(ALPHABET)  # folds into one literal
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    total = F.aggregate(
        codes,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda s, c: F.when(c < 0, s).otherwise(F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(F.element_at(ratios, (s["last"] * n + c + 1).cast("int")))).alias("sum"))),
        lambda s: s["sum"],
    )
    return total / (F.length(run) - 1)


def _placed(hits: Column, pieces: Column, kind: int) -> Column:
    """Spans of the hits: what splitting at them leaves tells where each one starts."""
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hit:string>>")
    return F.aggregate(
        F.arrays_zip(pieces.alias("piece"), hits.alias("hit")),
        F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["piece"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("bigint").alias("at"),
            F.when(x["hit"].isNull(), s["out"])
            .otherwise(F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["piece"])).cast("bigint").alias("start"), F.lit(kind).alias("kind"), (s["at"] + F.length(x["piece"]) + F.length(x["hit"])).cast("bigint").alias("end"), x["hit"].alias("hit")))))
            .alias("out"),
        ),
        lambda s: s["out"],
    )


def scan(docs: DataFrame, text: str = "text", least: float = LEAST_MEAN_LLR) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of (start, kind, end, hit) by start, then kind."""
    table = train(labelled_samples(docs.sparkSession))
    keep = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hit:string>>")
    found = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t")).select("*", *[F.regexp_extract_all("__t", F.lit(p), F.lit(0)).alias(f"__h{k}") for k, p in enumerate(patterns)])
    some = lambda k: F.size(f"__h{k}") > 0
    cut = found.select(
        *keep,
        *[f"__h{k}" for k in range(4)],
        *[F.when(some(k), F.split("__t", p, -1)).alias(f"__p{k}") for k, p in enumerate(patterns)],
        F.when(some(0), F.regexp_extract_all("__t", F.lit(ASSIGN), F.lit(2))).alias("__v"),
    )
    placed = cut.select(*keep, "__v", *[F.when(some(k), _placed(F.col(f"__h{k}"), F.col(f"__p{k}"), k)).otherwise(none).alias(f"__s{k}") for k in range(4)])
    long_enough = F.filter("__s0", lambda s, i: F.length(F.element_at(F.col("__v"), (i + 1).cast("int"))) >= ASSIGN_LEAST)
    based = placed.select(*keep, "__s3", F.array_sort(F.concat(F.when(F.size("__s0") > 0, long_enough).otherwise(none), "__s1", "__s2")).alias("base_spans"))
    free = F.filter("__s3", lambda s: ~F.exists("base_spans", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    judged = based.select(*keep, "base_spans", F.when(F.size("__s3") > 0, F.filter(free, lambda s: mean_llr(s["hit"], table) >= least)).otherwise(none).alias("__m"))
    return judged.select(*keep, "base_spans", F.when(F.size("__m") > 0, F.array_sort(F.concat("base_spans", "__m"))).otherwise(F.col("base_spans")).alias("all_spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.split(F.lit(",".join(KINDS)), ",")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every stretch that spans cover replaced by ``mask``."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s,
    )
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))).otherwise(text)
