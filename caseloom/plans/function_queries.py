"""Scalar functions over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import normalize as N
from caseloom.functions import scores as S
from caseloom.functions import similarity as M
from caseloom.registry import load, query

#: Raw forms made from whole rows of the driver's tables, for the normalizers to work on.
NAMES_SQL = """
names AS (SELECT c_custkey AS id,
  CASE c_custkey % 5 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'mr. ' WHEN 2 THEN '  Shri ' WHEN 3 THEN 'Smt ' ELSE '' END || replace(c_name, '#', ' ') || CASE WHEN c_custkey % 7 = 0 THEN '   s/o  Someone' ELSE '' END AS name,
  CASE c_custkey % 6 WHEN 0 THEN '+91 ' WHEN 1 THEN '0' WHEN 2 THEN '91' ELSE '' END || CAST(6000000000 + c_custkey * 7919 AS VARCHAR) AS phone,
  lower('dl-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-ab-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) AS plate,
  '  ' || c_mktsegment || ' Street,  Nagar ' || CAST(c_nationkey AS VARCHAR) || ' ' AS place,
  CASE c_custkey % 4 WHEN 0 THEN 'Madras' WHEN 1 THEN ' bombay ' WHEN 2 THEN 'Delhi' ELSE c_mktsegment END AS city,
  CASE c_custkey % 3 WHEN 0 THEN 'born ' || CAST(1950 + c_custkey % 60 AS VARCHAR) WHEN 1 THEN NULL ELSE '' END AS dob,
  CAST(18 + c_custkey % 50 AS VARCHAR) AS age, CAST(100000 + c_custkey AS VARCHAR) AS pin, c_mktsegment || ' Pvt. Ltd.' AS org
  FROM customer)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    digit = lambda n: F.pmod(key, F.lit(n))
    pick = lambda n, *own: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in own)), digit(n).cast("int") + 1)
    text = key.cast("string")
    return load(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.concat(pick(5, "Dr. ", "mr. ", "  Shri ", "Smt ", ""), F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")), F.when(digit(7) == 0, "   s/o  Someone").otherwise("")).alias("name"),
        F.concat(pick(6, "+91 ", "0", "91", "", "", ""), (F.lit(6000000000) + key * 7919).cast("string")).alias("phone"),
        F.lower(F.concat(F.lit("dl-"), F.lpad(digit(100).cast("string"), 2, "0"), F.lit("-ab-"), F.lpad(digit(10000).cast("string"), 4, "0"))).alias("plate"),
        F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" Street,  Nagar "), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("place"),
        pick(4, "Madras", " bombay ", "Delhi", F.col("c_mktsegment")).alias("city"),
        F.when(digit(3) == 0, F.concat(F.lit("born "), (1950 + digit(60)).cast("string"))).when(digit(3) == 2, "").alias("dob"),
        (18 + digit(50)).cast("string").alias("age"),
        (100000 + key).cast("string").alias("pin"),
        F.concat(F.col("c_mktsegment"), F.lit(" Pvt. Ltd.")).alias("org"),
    )


_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(f"""WITH {NAMES_SQL} SELECT id,
  {_SQUEEZE.format(r"regexp_replace(regexp_replace(lower(name), '[^\w\s]', '', 'g'), '\b(mr|mrs|ms|dr|prof|sir|smt|shri)\b', '', 'g')")} AS name,
  CASE WHEN p LIKE '+91%' AND length(p) > 3 THEN substr(p, 4) WHEN p LIKE '91%' AND length(p) = 12 THEN substr(p, 3) ELSE p END AS phone,
  regexp_replace(upper(plate), '[^A-Z0-9]', '', 'g') AS vehicle,
  {_SQUEEZE.format(r"regexp_replace(lower(place), '[^\w\s]', '', 'g')")} AS location
  FROM (SELECT *, regexp_replace(regexp_replace(phone, '[^\\d+]', '', 'g'), '^0', '') AS p FROM names)""")
def normalize_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1-X6."""
    c = F.col
    return names(spark, sf_dir).select("id", N.n_name(c("name")).alias("name"), N.n_phone(c("phone")).alias("phone"), N.n_vehicle(c("plate")).alias("vehicle"), N.n_location(c("place")).alias("location"))


_SOUNDEX = r"""CASE WHEN x = '' THEN '0000' ELSE rpad(substr(x, 1, 1) || replace(substr(list_aggregate(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN i > 1 AND substr(c, i, 1) = substr(c, i - 1, 1) THEN '' ELSE substr(c, i, 1) END), 'string_agg', ''), 2), '0', ''), 4, '0') END"""


@query(rf"""WITH {NAMES_SQL}, v AS (SELECT *,
  {_SQUEEZE.format(r"regexp_replace(regexp_replace(regexp_replace(trim(lower(name)), '^(mr\.|mrs\.|ms\.|shri|smt\.|dr\.|late|thiru)\s+', ''), '\s+(s/o|d/o|w/o)\s+.*$', ''), '[^a-z0-9\s]', ' ', 'g')")} AS vname,
  regexp_replace(phone, '\D', '', 'g') AS d FROM names),
  w AS (SELECT *, CASE WHEN length(d) = 12 AND d LIKE '91%' THEN substr(d, 3) WHEN length(d) = 11 AND d LIKE '0%' THEN substr(d, 2) ELSE d END AS p,
  regexp_replace(upper(vname), '[^A-Z]', '', 'g') AS x, nullif(regexp_extract(coalesce(dob, ''), '\b(19\d\d|20\d\d)\b', 1), '') AS y,
  translate(regexp_replace(upper(vname), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') AS c FROM v)
  SELECT id, vname AS name, CASE WHEN regexp_matches(p, '^[6-9]\d{{9}}$') THEN p END AS phone,
  {_SOUNDEX} AS phonetic_key, coalesce(CAST(y AS INT), 2024 - CAST(age AS INT)) AS birth_year, CAST(coalesce(CAST(y AS INT), 2024 - CAST(age AS INT)) AS VARCHAR) || '-01-01' AS dob,
  nullif({_SQUEEZE.format(r"regexp_replace(regexp_replace(regexp_replace(trim(lower(place)), '\b(street|st\.)\b', 'st', 'g'), '\b(nagar|ngr)\b', 'nagar', 'g'), '[^a-z0-9\s]', ' ', 'g')")}, '') AS address,
  CASE trim(lower(city)) WHEN 'madras' THEN 'chennai' WHEN 'bombay' THEN 'mumbai' WHEN 'delhi' THEN 'delhi' ELSE upper(trim(city)) END AS city,
  CASE WHEN regexp_matches(pin, '^[1-9]\d{{5}}$') THEN pin END AS pincode, regexp_replace(upper(plate), '[^A-Z0-9]', '', 'g') AS vehicle FROM w""")
def normalize_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7-X12, X17."""
    c = F.col
    dob, year = N.v_birth(c("dob"), c("age"), 2024)
    return names(spark, sf_dir).select("id", N.v_name(c("name")).alias("name"), N.v_phone(c("phone")).alias("phone"), N.phonetic_key(N.v_name(c("name"))).alias("phonetic_key"), year.alias("birth_year"), dob.alias("dob"), N.v_address(c("place")).alias("address"), N.v_city(c("city")).alias("city"), N.v_pincode(c("pin")).alias("pincode"), N.v_vehicle(c("plate")).alias("vehicle"))


@query(rf"""WITH {NAMES_SQL} SELECT id, regexp_replace(upper(plate), '[\s\-]', '', 'g') AS vehicle,
  CASE WHEN length(d) = 12 AND d LIKE '91%' THEN substr(d, 3) ELSE d END AS phone,
  upper(substr(o, 1, 1)) || lower(substr(o, 2)) AS organization
  FROM (SELECT *, regexp_replace(phone, '\D', '', 'g') AS d, {_SQUEEZE.format(r"regexp_replace(org, '\b(?:Pvt|Ltd)\b\.?', '', 'g')")} AS o FROM names)""")
def normalize_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X16."""
    c = F.col
    return names(spark, sf_dir).select("id", N.d_vehicle(c("plate")).alias("vehicle"), N.d_phone(c("phone")).alias("phone"), N.d_organization(c("org")).alias("organization"))


@query(r"""SELECT p_partkey AS id, CASE WHEN a = b THEN 100 WHEN contains(a, b) OR contains(b, a) THEN 80 ELSE 0 END AS match_score,
  CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS exact,
  round(CASE WHEN contains(a, b) OR contains(b, a) THEN 0.2 + 0.8 * least(length(a), length(b)) / greatest(length(a), length(b)) ELSE 0 END, 6) AS partial,
  round(len(list_intersect(x, y)) / sqrt(CAST(len(x) * len(y) AS DOUBLE)), 6) AS token_cosine,
  round(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))), 6) AS token_jaccard
  FROM (SELECT p_partkey, a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM (SELECT p_partkey, lower(p_name) AS a, lower(p_type || ' ' || split_part(p_name, ' ', 2)) AS b FROM part))""")
def name_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X18, X20, X21, X23, X24."""
    a, b = F.lower("p_name"), F.lower(F.concat_ws(" ", "p_type", F.element_at(F.split("p_name", " "), 2)))
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("id", M.match_score(a, b).alias("match_score"), M.exact(a, b).alias("exact"), F.round(M.partial(a, b), 6).alias("partial"), F.round(M.token_cosine(a, b), 6).alias("token_cosine"), F.round(M.set_jaccard(M.tokens(a), M.tokens(b)), 6).alias("token_jaccard"))


#: For p(id, a, b): j(id, a, b, j) with the Jaro similarity, a step for each character of a.
_JARO = """s AS (SELECT id, a, b, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS r, 1 AS i, b AS f, '' AS l FROM p UNION ALL
    SELECT id, a, b, r, i + 1, CASE WHEN k > 0 THEN substr(f, 1, low + k - 2) || chr(1) || substr(f, low + k) ELSE f END, CASE WHEN k > 0 THEN l || a[i] ELSE l END
    FROM (SELECT *, greatest(1, i - r) AS low, instr(substr(f, greatest(1, i - r), i + r - greatest(1, i - r) + 1), a[i]) AS k FROM s WHERE i <= length(a))),
  m AS (SELECT id, a, b, l, length(l) AS m, array_to_string([b[n] for n in range(1, length(b) + 1) if f[n] = chr(1)], '') AS g FROM s WHERE i > length(a)),
  j AS (SELECT id, a, b, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE (m::DOUBLE / length(a) + m::DOUBLE / length(b) + (m - len([n for n in range(1, m + 1) if l[n] != g[n]]) / 2.0::DOUBLE) / m) / 3 END AS j FROM m)"""
_WINKLER = "round(j + 0.1::DOUBLE * CASE WHEN a[1] != b[1] THEN 0 WHEN a[2] != b[2] THEN 1 WHEN a[3] != b[3] THEN 2 WHEN a[4] != b[4] THEN 3 ELSE 4 END * (1 - j), 6)"
#: Of x and y: n * 1000 - i of the longest common text, n characters from x[i] on, the first of equal ones; null if there is none.
_LONGEST = "list_max(flatten([[n * 1000 - i for n in range(1, length(x) - i + 2) if contains(y, substr(x, i, n))] for i in range(1, length(x) + 1)]))"

#: For p(id, a, b): ratios(id, ratio) of matching characters, by the longest common text and what lies left and right of it, again and again.
RATIO = f"""q AS (SELECT id, x, y, {_LONGEST} AS v FROM (SELECT id, a AS x, b AS y FROM p) UNION ALL
    SELECT id, x, y, {_LONGEST} FROM (SELECT id, unnest([substr(x, 1, i - 1), substr(x, i + n)]) AS x, unnest([substr(y, 1, k - 1), substr(y, k + n)]) AS y
      FROM (SELECT *, instr(y, substr(x, i, n)) AS k FROM (SELECT *, n * 1000 - v AS i FROM (SELECT *, (v + 999) // 1000 AS n FROM q WHERE v IS NOT NULL)))) WHERE x != '' AND y != ''),
  n AS (SELECT id, coalesce(sum((v + 999) // 1000), 0) AS same FROM q GROUP BY 1),
  ratios AS (SELECT id, 2.0::DOUBLE * same / (length(a) + length(b)) AS ratio FROM p JOIN n USING (id))"""


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, strip_accents(p_name) AS a, lower(p_type) AS b FROM part),
  {_JARO},
  {RATIO}
  SELECT id, round(ratio, 6) AS sequence_ratio, {_WINKLER} AS jaro_winkler FROM j JOIN ratios USING (id)""")
def name_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two character matchers and accents, over all parts' names and types."""
    rows = load(spark, sf_dir, "part")
    a, b = N.remove_accents(F.col("p_name")), F.lower("p_type")
    return rows.select(F.col("p_partkey").alias("id"), F.round(M.sequence_ratio(a, b), 6).alias("sequence_ratio"), F.round(M.jaro_winkler(a, b), 6).alias("jaro_winkler"))


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, lower(p_name) AS a, lower(p_type || ' ' || split_part(p_name, ' ', 2)) AS b FROM part UNION ALL SELECT -p_partkey, lower(p_name), substr(lower(p_name), 1, 3) || lower(p_type) FROM part),
  {_JARO}
  SELECT id, {_WINKLER} AS jaro_winkler FROM j""")
def name_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X22 over all parts, with pairs that share a beginning and pairs that need not."""
    a, kind = F.lower("p_name"), F.lower("p_type")
    rows = load(spark, sf_dir, "part")
    apart = rows.select(F.col("p_partkey").alias("id"), a.alias("a"), F.lower(F.concat_ws(" ", "p_type", F.element_at(F.split("p_name", " "), 2))).alias("b"))
    alike = rows.select((-F.col("p_partkey")).alias("id"), a.alias("a"), F.concat(F.substring(a, 1, 3), kind).alias("b"))
    return apart.unionByName(alike).select("id", F.round(M.jaro_winkler(F.col("a"), F.col("b")), 6).alias("jaro_winkler"))


@query("""SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(day(ts) AS INT) AS day_of_month, CAST(month(ts) AS INT) AS month,
  CAST(isodow(ts) >= 6 AS INT) AS weekend_flag, CAST(hour(ts) >= 22 OR hour(ts) <= 5 AS INT) AS night_activity_flag, CAST(hour(ts) BETWEEN 9 AND 17 AND isodow(ts) < 6 AS INT) AS business_hours_flag FROM events""")
def event_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X30."""
    return load(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in N.temporal_parts(F.col("ts")).items()))


@query("""SELECT event_id, CASE WHEN value > 60 THEN 'HIGH' WHEN value > 40 THEN 'MEDIUM' ELSE 'LOW' END AS anomaly, CASE WHEN value > 80 THEN 'HIGH' WHEN value > 50 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN value >= 35 THEN 'CRITICAL' WHEN value >= 25 THEN 'HIGH' WHEN value >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS temporal,
  CAST(least(100, greatest(10, 2 * (user_id % 40) + floor(value * 1000 / 50000) + 15 * (event_id % 3))) AS INT) AS strength,
  CAST(least(95, 50 + floor((user_id % 101) / 2)) AS INT) AS identity_confidence, round(least(0.5, (user_id % 700) / 600.0) + least(0.5, value * 30000 / 3000000), 6) AS fallback_score,
  CAST(least(100, round(70 * (event_id % 50) / 50.0 + 20 * least(user_id % 7, 5) / 5.0 + 10 * (event_id % 5) / greatest(event_id % 50, 1))) AS INT) AS activity FROM events""")
def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X32, X37, X38, X41, A18 on figures made from events."""
    e = load(spark, sf_dir, "events")
    v, u, i = F.col("value"), F.col("user_id"), F.col("event_id")
    return e.select(
        "event_id", S.anomaly_band(v / 100).alias("anomaly"), S.priority_band(v / 100).alias("priority"), S.temporal_band(v / 10).alias("temporal"),
        S.relationship_strength(u % 40, v * 1000, i % 3).alias("strength"), S.identity_confidence(u % 101).alias("identity_confidence"),
        F.round(S.fallback_lead_score(u % 700, v * 30000), 6).alias("fallback_score"), S.activity_score(i % 50, F.lit(50), u % 7, i % 5).alias("activity"),
    )


@query("""SELECT page_id, sha256(url) AS url_hash, sha256(concat_ws('|', page_id::VARCHAR, '2024-01-01T00:00:00', sha256(html), 'NONE', 'ADD')) AS block_hash, coalesce(nullif(trim(split_part(split_part(url, chr(10), 1), ',', -1)), ''), 'Local Sector') AS area FROM pages""")
def page_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X31, X35."""
    data = F.sha2("html", 256)
    return load(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("url_hash"), S.block_hash(F.col("page_id"), F.lit("2024-01-01T00:00:00Z"), data, F.lit("NONE"), F.lit("ADD")).alias("block_hash"), S.area_label(F.col("url")).alias("area"))


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'VEHICLE' WHEN c_acctbal < 3000 THEN 'PERSON' ELSE 'OTHER' END AS kind,
  CASE WHEN c_acctbal < 0 THEN '#81B29A' WHEN c_acctbal < 3000 THEN '#E07A5F' ELSE '#6C757D' END AS colour, CAST(least(4, 1 + CASE WHEN (c_custkey % 101) % 30 = 15 THEN 2 * round((c_custkey % 101) / 60.0) ELSE round((c_custkey % 101) / 30.0) END) AS INT) AS weight,
  CAST(least(5, greatest(1, round((c_custkey % 101) / 20.0))) AS INT) AS wide_weight FROM customer""")
def node_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X33, X34."""
    kind = F.when(F.col("c_acctbal") < 0, "VEHICLE").when(F.col("c_acctbal") < 3000, "PERSON").otherwise("OTHER")
    strength = F.col("c_custkey") % 101
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), kind.alias("kind"), S.type_colour(kind).alias("colour"), S.link_weight(strength).alias("weight"), S.link_weight_wide(strength).alias("wide_weight"))


@query("""SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) AS DOUBLE[])), 6) AS cosine FROM embeddings""")
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: every vector against the first one."""
    e = load(spark, sf_dir, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(F.broadcast(first)).select("vec_id", F.round(M.vector_cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"))
