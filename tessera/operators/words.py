"""Words from their segments: text in order, what the main segment says of the word, and the segments themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features with fields of their own.
OWN_FIELDS = ("ROOT", "LEM", "affix")


def fold_segments(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, text, pos, root, lemma, features, segments) from segments (keys, order, form, tag, features as a map).

    The main segment is the first that is neither a prefix nor a suffix, else the first; root, lemma and features are its,
    without the features that have fields of their own. segments: form, tag, affix and root of each in order.
    """
    affix = F.col("features")["affix"]
    marked = rows.withColumns({"_aside": F.coalesce(affix.isin("PREF", "SUFF"), F.lit(False)).cast("int"), "_affix": affix})
    rest = F.map_filter("features", lambda k, _: ~k.isin(*OWN_FIELDS))
    main = F.struct(F.col("tag").alias("pos"), F.col("features")["ROOT"].alias("root"), F.col("features")["LEM"].alias("lemma"), rest.alias("features"))
    one = F.struct(F.col(order).alias("_o"), "form", "tag", F.col("_affix").alias("affix"), F.col("features")["ROOT"].alias("root"))
    listed = F.array_sort(F.collect_list(one), lambda x, y: F.when(x["_o"] < y["_o"], -1).when(x["_o"] > y["_o"], 1).otherwise(0))
    found = marked.groupBy(*keys).agg(F.min_by(main, F.struct("_aside", order)).alias("m"), listed.alias("s"))
    return found.select(
        *keys, F.array_join(F.transform("s", lambda x: x["form"]), "").alias("text"), "m.pos", "m.root", "m.lemma", "m.features",
        F.transform("s", lambda x: x.dropFields("_o")).alias("segments"),
    )
