"""Items as a stream: new JSON lines are matched to the static training statistics as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.config import RARE, Options
from spanlens.functions.text import join_tokens
from spanlens.sources.annotated import ITEM


def stream_items(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    items = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return items.withColumn("sentence", F.coalesce("sentence", join_tokens(F.col("tokens"))))


def missed_tokens(items: DataFrame, stats: DataFrame, o: Options) -> DataFrame:
    """(id, pos, token) of tokens that are entities by the statistics and lie in no prediction; stateless."""
    inside = F.flatten(F.transform(F.coalesce("ent_list_pred", F.expr("cast(array() as array<struct<name:string,type:string,token_idx:array<int>>>)")), lambda x: F.sequence(x["token_idx"][0], x["token_idx"][1])))
    rows = items.select("id", inside.alias("inside"), F.posexplode("tokens").alias("pos", "token")).where(~F.array_contains("inside", F.col("pos")))
    strong = stats.where((F.col("r_ent") > o.entity_bound_fn) & (F.col("n_tot") > RARE)).select("token")
    return rows.join(strong, "token").select("id", "pos", "token")
