"""Operator 7: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has the exponential key -ln(u) / weight, u from a hash of seed and id, so that ascending keys are a
weighted sample without replacement. A source's token budget is first met by complete epochs; the rest takes the
documents in order of their keys as long as the sum of their tokens stays within it.

At scale: the keys are cut into cells, CELLS for each factor of e, so that no weights crowd them; sums per (source, cell) say which cells a budget takes whole, and only the one
cell of each source in which the budget ends is sorted. What is joined to the documents is a row per source, a table in
the shared folder whose size Spark knows when it chooses the join; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, table, written

CELLS = 1024
#: No weight is less: keys stay finite.
LEAST = 1e-6
SYMBOLS = r"[!#$%&*|<>{}=_~^\\]"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column, tokens: Column) -> Column:
    """A rule for the weight of a text without a model: 1 for prose of many lines, less for symbols and for lines that repeat."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x)), lambda x: x != "")
    return (1 / (1 + F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)) / tokens)) * (F.size(F.array_distinct(lines)) / F.size(lines))


def mix_sources(docs: DataFrame, total_tokens: int | None = None, targets: dict[str, float] | None = None, alpha: float = 0.5, seed: int = 42, epoch: str | None = None, tokens: str | None = None, weight: Column | None = None) -> DataFrame:
    """The rows of docs as often as the mixture takes them, with docs' columns (and the epoch, from 1, and the tokens, if named).

    total_tokens: the budget; by default the tokens of docs. targets: a weight for each source, 0 for those it lacks;
    by default a source's tokens to the power alpha. weight: a document's quality, above 0, as a classifier gives it; by
    default quality_weight(). Weights that are null or below LEAST count as LEAST. Tokens are runs of non-space characters.
    Null cases: a null source is a source of its own (targets: under the key None); rows without tokens (null or blank
    texts) are left out; null ids draw by their texts; equal keys (repeated rows) are taken in order of id and text
    hash, so equal rows are interchangeable; texts are read whole, however long. An empty table gives an empty one. Other columns, whatever their names,
    pass through.
    """
    spark = docs.sparkSession
    tok, key, cell, last_cell, src, cut, full, n, tie = fresh(docs, "tok", "key", "cell", "last_cell", "src", "cut", "full", "n", "tie")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = docs.withColumn(tok, token_count(F.col("text"))).filter(F.col(tok) > 0)
    keyed = keyed.withColumn(key, -F.log(u) / F.greatest(F.coalesce(quality_weight(F.col("text"), F.col(tok)) if weight is None else weight.cast("double"), F.lit(LEAST)), F.lit(LEAST)))
    order = F.struct(F.col(key), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"))
    # texts are read twice: for these columns, and for the rows that are taken
    narrow = written(keyed.select(F.col("source").alias(src), tok, F.floor(F.log(F.col(key)) * CELLS).alias(cell), order.alias(tie)), "mix-keys")

    cells = written(narrow.groupBy(src, cell).agg(F.sum(tok).alias(tok)), "mix-cells")
    sums = cells.groupBy(src).agg(F.sum(tok).alias("have"))
    if targets is None:
        sums = sums.withColumn("w", F.round(1000 * F.pow(F.col("have").cast("double"), F.lit(alpha))))
    else:
        wanted = spark.createDataFrame([(s, float(x)) for s, x in targets.items()], "named string, w double")
        sums = sums.join(wanted, F.col(src).eqNullSafe(F.col("named")), "left").drop("named").fillna(0.0, ["w"])
    whole = sums.agg(F.sum("w").alias("all_w"), F.sum("have").alias("all_have"))
    total = F.col("all_have") if total_tokens is None else F.lit(int(total_tokens))
    budget = F.floor(total * (F.col("w") / F.col("all_w")))
    sums = sums.crossJoin(whole).withColumn("budget", F.coalesce(F.when(F.col("all_w") > 0, budget), F.lit(0))).select(src, F.floor(F.col("budget") / F.col("have")).alias(full), F.expr("budget % have").alias("rest"))
    before = F.coalesce(F.sum(tok).over(W.partitionBy(src).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = cells.withColumn("before", before).join(sums.withColumnRenamed(src, "s"), F.col(src).eqNullSafe(F.col("s")))
    ends = written(ends.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col(tok) > F.col("rest"))).select(F.col("s"), F.col(cell).alias("c"), full, (F.col("rest") - F.col("before")).alias("rest")), "mix-ends")

    # of the cell in which the budget ends: the last document that fits
    last = narrow.join(ends, F.col(src).eqNullSafe(F.col("s")) & (F.col(cell) == F.col("c")))
    last = last.withColumn("sum", F.sum(tok).over(W.partitionBy("s").orderBy(tie).rowsBetween(W.unboundedPreceding, 0)))
    last = last.groupBy("s").agg(F.max(F.when(F.col("sum") <= F.col("rest"), F.col(tie))).alias(cut)).withColumnRenamed("s", "s2")
    cuts = written(ends.join(last, F.col("s").eqNullSafe(F.col("s2")), "left").select(F.col("s").alias(src), F.col("c").alias(last_cell), full, cut), "mix-cuts")

    taken = keyed.join(cuts, F.col("source").eqNullSafe(F.col(src)))
    here = F.floor(F.log(F.col(key)) * CELLS)
    partly = (here < F.col(last_cell)) | ((here == F.col(last_cell)) & F.coalesce(order <= F.col(cut), F.lit(False)))
    taken = taken.withColumn(n, F.col(full) + F.when(partly, 1).otherwise(0)).filter(F.col(n) > 0)
    out = taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))))
    return out.select(*docs.columns, *([F.col(n).alias(epoch)] if epoch else []), *([F.col(tok).alias(tokens)] if tokens else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text", "source")
    return mix_sources(docs, epoch="epoch", tokens="n_tokens").select("doc_id", "source", "epoch", "n_tokens")


SQL = r"""
with d as (select doc_id, source, text, len(regexp_extract_all(text, '\S+'))::bigint n_tokens,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as ls from documents),
k as (select doc_id, source, n_tokens,
    -ln((('0x' || substr(md5('42:' || doc_id::varchar), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
    / greatest((1 / (1 + len(regexp_extract_all(text, '[!#$%&*|<>{}=_~^\\]'))::double / n_tokens))
        * (len(list_distinct(ls))::double / len(ls)), 1e-6) as key from d where n_tokens > 0),
s as (select source, sum(n_tokens)::bigint have, round(1000 * pow(sum(n_tokens)::double, 0.5)) w from k group by 1),
b as (select source, have, floor((sum(have) over ())::bigint * (w / sum(w) over ()))::bigint budget from s),
r as (select k.*, budget // have as epochs, budget % have as rest,
    sum(n_tokens) over (partition by k.source order by key, doc_id rows unbounded preceding) as run
    from k join b on k.source is not distinct from b.source),
c as (select doc_id, source, n_tokens, epochs + case when run <= rest then 1 else 0 end as copies from r)
select doc_id, source, unnest(range(1, copies + 1))::bigint as epoch, n_tokens from c where copies > 0
"""
