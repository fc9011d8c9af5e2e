"""Model studies."""

from pyspark.sql import functions as F

from ..ml import rankers as R
from ..operators import features as FE
from ..operators.labels import forward_label, model_features
from ..operators.validation import expanding_folds
from ..sources import panel as P
from .catalog import query


def frame(spark, sf):
    def build():
        labels = P.kept(spark, sf, "labels", lambda: forward_label(P.kept(spark, sf, "reversals", lambda: FE.reversal_signals(P.with_returns(spark, sf))), P.calendar(spark, sf)))
        simple = labels.withColumn("label", F.col("forward"))
        return R.rank_target(R.model_frame(model_features(P.with_returns(spark, sf)), simple))

    return P.kept(spark, sf, "model_frame", build)


@query("ML-01 ML-02", "symbol session ~label ~target label_end", digits=5, parts="grid", sql="""
SELECT symbol, session, label, label_end, (rank() OVER (PARTITION BY session ORDER BY label) + (count(*) OVER (PARTITION BY session, label)-1)/2.0)/count(*) OVER (PARTITION BY session) AS target FROM (
SELECT symbol, session, px, lead(px,6) OVER w/lead(px,1) OVER w - 1 AS label, lead(session,6) OVER w AS label_end FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY pos)) WHERE px IS NOT NULL AND label IS NOT NULL""")
def model_frame(spark, sf):
    return frame(spark, sf)


def split(spark, sf):
    f = frame(spark, sf)
    cut = F.lit("1999-07-01").cast("date")
    return f.where(F.col("label_end") < cut), f.where(F.col("session") >= cut)


@query("ML-03", "symbol session spec ~score", digits=4)
def linear_rankers(spark, sf):
    train, test = split(spark, sf)
    ridge = R.predict(R.linear_ranker(0.1).fit(train), test).withColumn("spec", F.lit("ridge"))
    return ridge.unionByName(R.predict(R.linear_ranker(0.01, 0.5).fit(train), test).withColumn("spec", F.lit("elastic_net")))


@query("ML-04", "symbol session ~score", digits=4)
def boosted_ranker(spark, sf):
    train, test = split(spark, sf)
    return R.predict(R.boosted_ranker().fit(train), test)


@query("ML-05", "symbol session ~score", digits=4)
def take_or_skip(spark, sf):
    train, test = split(spark, sf)
    y = lambda d: d.withColumn("take", (F.col("label") > 0).cast("double"))
    return R.predict(R.meta_labeler().fit(y(train)), y(test), probability=True)


@query("ML-06", "spec session #n ~ic ~spread", digits=4)
def purged_model_study(spark, sf):
    folds = expanding_folds(P.calendar(spark, sf), 5)
    specs = {"ridge": R.linear_ranker(0.1), "boosted": R.boosted_ranker(3, 2)}
    ids = [r["fold"] for r in folds.select("fold").orderBy("fold").collect()]
    return R.purged_study(frame(spark, sf), folds, specs, ids)[1]
