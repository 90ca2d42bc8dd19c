"""The post-level robustness fits against least squares with dummies."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from geopanel.operators import panel
from geopanel.plans import queries

SF = "/root/testdata/sf0.001"


def dummies(rows, outcome, terms, effects, weights=None):
    rows = rows.dropna(subset=[outcome, *terms]).reset_index(drop=True)
    x = pd.concat([rows[terms].astype(float), *[pd.get_dummies(rows[e].astype(str)).astype(float) for e in effects]], axis=1)
    w = np.sqrt(rows[weights].to_numpy(float) if weights else np.ones(len(rows)))
    solved = np.linalg.lstsq(x.to_numpy() * w[:, None], rows[outcome].to_numpy(float) * w, rcond=None)[0]
    return solved[: len(terms)]


def test_robustness_posts_absorbs_the_effects_of_its_fits(spark):
    got = {(r["subset"], r["outcome"], r["term"]): r["estimate"] for r in queries.robustness_posts(spark, SF).collect()}
    assert {k[0] for k in got} == {"bots", "without_two", "topic", "topic_users"}
    posts = queries.individual_posts(spark, SF)
    some = panel.build_panel(posts.where(~F.col("STATE_NAME").isin("AFRICA", "ASIA")))
    some = some.withColumn("temp_med_sq", F.col("temp_med") ** 2).toPandas()
    topic = posts.where(F.col("main_label") == "'click'").toPandas()
    for subset, rows, terms, effects, weights in (
        ("without_two", some, queries.PANEL_TERMS, ["CNTY_UNIQUE", "date", "day"], "num_tweets"),
        ("topic", topic, queries.POST_TERMS, ["CNTY_UNIQUE", "date"], None),
        ("topic_users", topic, ["pm25"], ["NAME", "date", "username"], None),
    ):
        want = dummies(rows, "vader_compound", terms, effects, weights)
        found = [got[subset, "vader_compound", t] for t in terms]
        assert np.allclose(found, want, rtol=1e-3, atol=2e-5), (subset, found, want)
