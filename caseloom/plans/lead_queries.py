"""Explanations of leads: additive contributions, their sentences, sources and the records behind them, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.scores import FEATURE_TEXTS, WARNING
from caseloom.operators import behaviour as B
from caseloom.operators import explain as X
from caseloom.operators import ml as K
from caseloom.plans import views as V
from caseloom.plans.activity_queries import _LEADS
from caseloom.registry import query

_KEY = ("p1", "p2")


@query()
def lead_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four features that add most to a pair's score, with what they add to the margin and all that makes it up."""
    f = B.labelled_leads(V.leads(spark, sf_dir))
    model = K.lead_model(f)
    if model is None:
        return X.top_factors(f.withColumns({"base_margin": F.lit(0.0), "contributions": F.array(*(F.lit(0.0) for _ in K.LEAD_FEATURES))}).limit(0), _KEY, K.LEAD_FEATURES)
    return X.top_factors(X.explained(X.fitted_trees(model, len(K.LEAD_FEATURES)), f, K.LEAD_FEATURES), _KEY, K.LEAD_FEATURES)


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lead's features that lie over the mean of all pairs, positive, and those under it, negative, unless they are equal."""
    f = V.leads(spark, sf_dir)
    means = f.agg(*(F.round(F.avg(F.col(c).cast("double")), 6).alias(f"mean_{c}") for c in K.LEAD_FEATURES))
    # One row of means; a pair's rows come from it alone.
    return X.against_means(f.crossJoin(F.broadcast(means)), _KEY, K.LEAD_FEATURES)


_LONG = " UNION ALL ".join(f"SELECT p1, p2, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM ld" for c in K.LEAD_FEATURES)
_SHOWN = {"total_amount": "CAST(CAST(CAST(CAST(value AS VARCHAR) AS DECIMAL(24, 4)) AS DECIMAL(20, 2)) AS VARCHAR)"}
_TEXT = "CASE feature " + " ".join(f"WHEN '{c}' THEN '" + text.replace("%s", f"' || {_SHOWN.get(c, 'CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)')} || '").replace("%%", "%") + "'" for c, text in FEATURE_TEXTS.items()) + " ELSE 'Feature ' || feature || ' contributed ' || CASE WHEN value > mean THEN 'positively' ELSE 'negatively' END || '.' END"
_FACTORS = f"""{_LEADS}, lg AS ({_LONG}), av AS (SELECT feature, round(avg(value), 6) AS mean FROM lg GROUP BY 1), fc AS (SELECT p1, p2, feature, value, mean, CASE WHEN value > mean THEN 'positive' ELSE 'negative' END AS direction, {_TEXT} || CASE WHEN value > mean THEN '{WARNING}' ELSE '' END AS explanation,
  CASE WHEN regexp_matches(feature, 'call|communication') THEN 'calls' WHEN regexp_matches(feature, 'amount|transaction') THEN 'transactions' WHEN regexp_matches(feature, 'visit|location') THEN 'location events' ELSE 'master intelligence' END AS source FROM lg JOIN av USING (feature) WHERE round(value, 6) <> mean)"""


@query(f"WITH {_FACTORS} SELECT p1, p2, feature, value, direction, explanation, source FROM fc")
def lead_feature_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X39, X40's source: every feature of every pair, held against the mean of all pairs."""
    return _factors(spark, sf_dir).select(*_KEY, "feature", "value", "direction", "explanation", "source")


@query(f"""WITH {_FACTORS}, rw AS (SELECT least('C' || o_custkey, 'S' || l_suppkey) AS p1, greatest('C' || o_custkey, 'S' || l_suppkey) AS p2, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS record_id, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  rc AS (SELECT p1, p2, 'calls' AS source, record_id FROM rw UNION ALL SELECT p1, p2, 'transactions', record_id FROM rw WHERE l_returnflag = 'R')
  SELECT fc.p1, fc.p2, feature, rc.source, record_id FROM fc JOIN rc ON fc.p1 = rc.p1 AND fc.p2 = rc.p2 AND (fc.source = rc.source OR fc.source = 'master intelligence') WHERE direction = 'positive'""")
def lead_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source records behind each feature that speaks for a lead."""
    return X.evidence_records(_factors(spark, sf_dir).where("direction = 'positive'"), _KEY, V.contact_records(spark, sf_dir))
