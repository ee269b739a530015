"""Near duplicates by several rules at once: rows that agree by any rule are one class, and so are chains of such rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of an address: scheme, authority, path, query. What follows # is left out.
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)"


def _unescaped(part: Column) -> Column:
    """Escapes of letters, digits and -._~ are decoded, the others' digits are upper case."""

    def one(x: Column, i: Column) -> Column:
        code = F.conv(F.substring(x, 1, 2), 16, 10).cast("int")
        plain = F.chr(code).rlike("^[A-Za-z0-9._~-]$")
        escaped = F.when(plain, F.concat(F.chr(code), F.substr(x, F.lit(3)))).otherwise(F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2)), F.substr(x, F.lit(3))))
        return F.when(i == 0, x).when(x.rlike("^[0-9A-Fa-f]{2}"), escaped).otherwise(F.concat(F.lit("%"), x))

    return F.array_join(F.transform(F.split(part, "%"), one), "")


def canonical_url(url: Column) -> Column:
    """One spelling per address: scheme and host in lower case, no default port, no fragment, plain escapes, parameters sorted, / for an
    empty path. Null where it is no absolute address."""
    scheme, authority, path, query = (F.regexp_extract(F.trim(url), URL, i) for i in range(1, 5))
    scheme = F.lower(scheme)
    port = F.when(scheme == "http", ":80").when(scheme == "https", ":443").otherwise(":")
    host = F.lower(authority)
    host = F.when(F.endswith(host, port), F.substr(host, F.lit(1), F.length(host) - F.length(port))).otherwise(F.regexp_replace(host, ":$", ""))
    params = F.array_join(F.array_sort(F.filter(F.split(_unescaped(query), "&"), lambda p: p != "")), "&")
    path = F.when(path == "", "/").otherwise(_unescaped(path))
    made = F.concat(scheme, F.lit("://"), host, path, F.when(params == "", "").otherwise(F.concat(F.lit("?"), params)))
    return F.when(scheme != "", made)


def _checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder the session names; a local session without one gets its own."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def classes(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, class_id): the smallest key that a row is linked with through rows with an equal, non-null value of some rule.

    A value and its rows are never paired up: each round takes the smallest label per value and then per row, with partial sums before
    each shuffle, and jumps to the label's own label, so that chains halve. Keys that share no value are their own class; keys are unique
    and a null one takes no part."""
    rows = df.where(F.col(key).isNotNull())
    pairs = rows.select(F.col(key).alias("id"), F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.cast("string").alias("value")) for n, c in rules.items()])).alias("x"))
    pairs = pairs.select("id", "x.rule", "x.value").where("value is not null")
    shared = pairs.groupBy("rule", "value").agg(F.count("*").alias("n")).where("n > 1").select("rule", "value")
    links = _checkpointed(pairs.join(shared, ["rule", "value"]).select("id", "rule", "value"))
    labels = _checkpointed(links.groupBy("id").agg(F.min("id").alias("label")))
    while True:
        least = links.join(labels, "id").groupBy("rule", "value").agg(F.min("label").alias("label"))
        mine = links.join(least, ["rule", "value"]).groupBy("id").agg(F.min("label").alias("near"))
        onward = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        new = _checkpointed(mine.join(onward, "near").join(labels, "id").select("id", F.least("near", "far", "label").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved")))
        if not new.where("moved").limit(1).count():
            break
        labels = new.drop("moved")
    found = rows.select(F.col(key).alias("id")).join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("class_id"))
    return found.withColumnRenamed("id", key)
