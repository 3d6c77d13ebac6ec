"""Choosing documents by key without moving the texts of all others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.storage import written


def only(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is among ids (one column). As in without, the filter and the join behind it: what a full filter lets pass is left out all the same."""
    ids = written(ids.toDF("chosen").where("chosen is not null").distinct())
    passed = marked(docs, ids, key).where("tidemark_may_go").drop("tidemark_may_go")
    return passed.join(ids, passed[key] == ids["chosen"], "left_semi")


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key isn't among ids (one column); rows with a null key stay.

    A Bloom filter of fixed size lets most rows pass where they are; only those it
    can't clear are joined with ids, so their texts alone are shuffled.
    """
    ids = written(ids.toDF("gone").where("gone is not null").distinct())
    flagged = marked(docs, ids, key)
    clear = flagged.where("not tidemark_may_go").drop("tidemark_may_go")
    doubtful = flagged.where("tidemark_may_go").drop("tidemark_may_go")
    return clear.unionByName(doubtful.join(ids, doubtful[key] == ids["gone"], "left_anti"))


def marked(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """docs with tidemark_may_go: whether the key may be among ids."""
    wanted = bloom.build(ids.select(F.xxhash64(ids.columns[0])))

    @F.pandas_udf("boolean")
    def may_go(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            out = np.zeros(len(h), bool)
            out[bloom.passing(wanted, h.to_numpy(np.int64).view(np.uint64))] = True
            yield pd.Series(out)

    return docs.withColumn("tidemark_may_go", may_go(F.xxhash64(key)))
