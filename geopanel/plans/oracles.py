"""The registered queries as SQL over the raw tables.

Written from the operators' definitions: windows, self-contained geometry and
normal equations, none of the library's slicing, salting or summing.
"""

from __future__ import annotations

from geopanel.functions.text import TOPICS
from geopanel.functions.units import GRID_VARIABLES
from geopanel.operators.panel import PANEL_MEDIANS, SENTIMENTS

ORACLES: dict[str, str] = {}

POSTS = """
posts0 AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events
),
posts AS (
  SELECT event_id AS id, 'u' || CAST(user_id AS VARCHAR) AS username, user_id, ts AS timestamp,
         CASE WHEN event_id % 11 = 0 THEN '[]' ELSE '[''' || event_type || ''', ''other'']' END AS label,
         CASE WHEN event_id % 11 = 0 THEN '''no_topic''' ELSE '''' || event_type || '''' END AS main_label,
         event_type || ' ' || props AS text,
         value / 503::DOUBLE AS vader_compound,
         k / 100::DOUBLE AS percent_score,
         k / 101::DOUBLE AS roberta_positive,
         (k * 7 % 100) / 101::DOUBLE AS roberta_negative,
         ((k * 3 + event_id) % 100) / 101::DOUBLE AS bertweet_positive,
         ((k * 13 + 5) % 100) / 101::DOUBLE AS bertweet_negative,
         value / 5.03::DOUBLE AS pm25,
         (event_id * 31 % 400) / 10.3::DOUBLE - 5 AS temperature,
         (event_id * 17 % 90) / 10.3::DOUBLE AS precipitation,
         (event_id * 29 % 1000) / 10.3::DOUBLE AS visibility,
         (event_id * 41 % 200) / 10.3::DOUBLE - 10 AS wind_x,
         (event_id * 43 % 170) / 10.3::DOUBLE - 8 AS wind_y,
         (event_id * 47 % 300) / 10.3::DOUBLE - 8 AS dewpoint,
         (event_id * 59 % 20) / 10.3::DOUBLE AS aod550,
         (event_id * 61 % 1000) / 10.3::DOUBLE AS clouds,
         (2400 + event_id * 53 % 2600) / 100::DOUBLE AS lat,
         (-12500 + event_id * 37 % 5900) / 100::DOUBLE AS lon
  FROM posts0
)"""

COUNTY = (
    POSTS
    + """,
county_posts AS (
  SELECT p.*, n_name AS NAME, r_name AS STATE_NAME, n_name || ' ' || r_name AS CNTY_UNIQUE,
         CAST(p.timestamp AS DATE) AS date, date_trunc('hour', p.timestamp) AS time_bin
  FROM posts p JOIN nation ON p.user_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
)

RESULT_PANEL = (
    COUNTY
    + """,
raw_panel AS (
  SELECT CNTY_UNIQUE, date, count(*) AS num_tweets, max(temperature) AS temp_max, min(temperature) AS temp_min,
"""
    + ", ".join(f"quantile_cont({column}, 0.5) AS {name}" for name, column in PANEL_MEDIANS.items())
    + """
  FROM county_posts WHERE main_label <> '''no_topic''' GROUP BY CNTY_UNIQUE, date
)"""
)


def bins(value: str, breaks: list[str]) -> str:
    """Right-closed bin label as CASE; the first bin includes its lower end."""
    cases = [f"WHEN {value} < {breaks[0]} THEN NULL"]
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:])):
        opening = "[" if i == 0 else "("
        label = f"'{opening}{lo},{hi}]'"
        if hi == "Inf":
            cases.append(f"WHEN {value} IS NOT NULL THEN {label}")
        else:
            cases.append(f"WHEN {value} <= CAST({hi} AS DOUBLE) THEN {label}")
    return "CASE " + " ".join(cases) + " END"


POLLUTION = [str(v) for v in range(0, 75, 5)] + ["Inf"]
COARSE = [str(v) for v in range(0, 110, 10)] + ["Inf"]
TENTHS = ["0"] + [f"0.{v}" for v in range(1, 10)] + ["1"]


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0::DOUBLE"


def time_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def date_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def z(column: str, over: str) -> str:
    """Standardised column over a window; NULL when it does not vary."""
    return (
        f"CASE WHEN max({column}) OVER ({over}) > min({column}) OVER ({over}) THEN "
        f"({column} - avg({column}) OVER ({over})) / stddev_samp({column}) OVER ({over}) END"
    )


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- panel -----------------------------------------------------------------

MEASURES = list(PANEL_MEDIANS)
BY_REGION = "PARTITION BY CNTY_UNIQUE"

add(
    "panel_zscore_flagship",
    f"""WITH {RESULT_PANEL},
scaled AS (SELECT date, num_tweets, {", ".join(f"{z(m, BY_REGION)} AS {m}" for m in [*MEASURES, "temp_max", "temp_min"])} FROM raw_panel)
SELECT {date_text("date")} AS date, CAST(sum(num_tweets) AS BIGINT) AS num_tweets,
       {", ".join(f"{r6(f'avg({m})')} AS {m}" for m in [*MEASURES, "temp_max", "temp_min"])}
FROM scaled GROUP BY date""",
)
add(
    "build_panel",
    f"""WITH {RESULT_PANEL}
SELECT CNTY_UNIQUE, {date_text("date")} AS date, num_tweets,
       {", ".join(f"{r6(m)} AS {m}" for m in [*MEASURES, "temp_max", "temp_min"])},
       {bins("pm25", POLLUTION)} AS pm25_cat, CAST(dayofweek(date) AS BIGINT) AS day
FROM raw_panel""",
)
add(
    "panel_zscore",
    f"""WITH {RESULT_PANEL}
SELECT CNTY_UNIQUE, {date_text("date")} AS date, num_tweets, {", ".join(f"{r6(z(m, BY_REGION))} AS {m}" for m in MEASURES)}
FROM raw_panel""",
)
add(
    "zscore_global",
    f"""WITH {POSTS} SELECT id, {r6(z("pm25", ""))} AS pm25, {r6(z("vader_compound", ""))} AS vader_compound FROM posts""",
)
add(
    "zscore_by_user",
    f"""WITH {POSTS} SELECT id, username, {r6(z("pm25", "PARTITION BY username"))} AS pm25 FROM posts""",
)

# --- parsing ---------------------------------------------------------------

add(
    "parse_posts",
    r"""SELECT CAST(event_id AS VARCHAR) AS id, 'u,' || CAST(user_id AS VARCHAR) AS username,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
       'post,' || event_type || chr(10) || 'line }' || CASE WHEN event_id % 7 = 0 THEN ' ' ELSE '' END AS text,
       CAST(event_id % 2 AS VARCHAR) AS geo_available,
       CAST(event_id % 50 AS VARCHAR) || ' ' || CAST(event_id % 70 AS VARCHAR) AS coordinates
FROM events WHERE event_id % 5 <> 0 AND event_id % 23 <> 0""",
)
add(
    "parse_reject_counts",
    """SELECT CAST(n_fields AS BIGINT) AS n_fields, count(*) AS records, n_fields = 17 AS accepted FROM (
  SELECT CASE WHEN event_id % 5 = 0 THEN 16 WHEN event_id % 23 = 0 THEN 1 ELSE 17 END AS n_fields FROM events
) GROUP BY n_fields""",
)
add(
    "parsed_points",
    """SELECT event_id AS id, event_type || ' zone' AS region,
       (-12500 + event_id * 37 % 5900) / 100::DOUBLE AS lon, (2400 + event_id * 53 % 2600) / 100::DOUBLE AS lat
FROM events WHERE event_id % 8 <> 0 AND event_id % 50 <> 3""",
)

# --- files -----------------------------------------------------------------

ORACLES["raw_dump"] = ORACLES["parse_posts"]
add(
    "delimited_table",
    """SELECT CAST(event_id AS VARCHAR) AS id, 'u' || CAST(user_id AS VARCHAR) AS username, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
  event_type || CASE WHEN event_id % 3 = 0 THEN chr(10) || '|' ELSE ' ' END || props AS text, CAST(event_id % 2 AS VARCHAR) AS geo_available,
  CASE WHEN event_id % 5 <> 0 THEN CAST((2400 + event_id * 53 % 2600) // 100 AS VARCHAR) || '.' || lpad(CAST((2400 + event_id * 53 % 2600) % 100 AS VARCHAR), 2, '0')
    || ' -' || CAST((12500 - event_id * 37 % 5900) // 100 AS VARCHAR) || '.' || lpad(CAST((12500 - event_id * 37 % 5900) % 100 AS VARCHAR), 2, '0') END AS coordinates
FROM events""",
)
add("delimited_single_lines", f"WITH {POSTS} SELECT id, username, text, {r6('pm25')} AS pm25 FROM posts")
add(
    "saved_table",
    f"""WITH {POSTS} SELECT {date_text("CAST(timestamp AS DATE)")} AS date, count(*) AS posts, min(username) AS first, {r6("avg(pm25)")} AS pm25
FROM posts GROUP BY CAST(timestamp AS DATE)""",
)
add(
    "id_archives",
    """SELECT CAST(doc_id // 1000 AS VARCHAR) || '/' || CAST(doc_id // 300 AS VARCHAR) || '_ID.txt' AS file,
  row_number() OVER (PARTITION BY doc_id // 1000, doc_id // 300 ORDER BY doc_id) - 1 AS line, CAST(doc_id AS VARCHAR) AS id FROM documents""",
)
add(
    "row_key_scores",
    f"""WITH {POSTS}, numbered AS (SELECT *, row_number() OVER (ORDER BY id) AS X1 FROM posts)
SELECT X1, username, {r6("vader_compound")} AS vader_compound, {r6("roberta_positive")} AS roberta_positive, {r6("roberta_negative")} AS roberta_negative, label
FROM numbered WHERE id % 10 NOT IN (1, 3)""",
)

# --- text and scores -------------------------------------------------------

add(
    "normalize_posts",
    """SELECT doc_id, array_to_string(list_transform(
  string_split('@ @' || source || '  ' || text || ' http://x/' || CAST(doc_id AS VARCHAR), ' '),
  lambda w: CASE WHEN starts_with(w, '@') AND length(w) > 1 THEN '@user' WHEN starts_with(w, 'http') THEN 'http' ELSE w END
), ' ') AS text FROM documents""",
)
add("escape_post_quotes", """SELECT event_id, replace(props, '"', '&quot;') AS text FROM events""")
add("main_topic_per_post", f"WITH {POSTS} SELECT id, main_label FROM posts")
add(
    "lexicon_compound",
    f"""WITH lexicon(token, valence) AS (VALUES
  ('the', 1.5::DOUBLE), ('of', -0.5), ('and', 0.7), ('to', -1.2), ('le', 1.1), ('la', -0.4),
  ('und', 0.9), ('der', -1.6), ('el', 2.1), ('de', -0.8), ('que', 0.3), ('is', 1.9)),
words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}'']+')) AS token FROM documents),
sums AS (SELECT doc_id, sum(valence) AS s FROM words JOIN lexicon USING (token) GROUP BY doc_id)
SELECT doc_id, {r6("coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15)")} AS compound
FROM documents LEFT JOIN sums USING (doc_id)""",
)
add(
    "score_batches_softmax",
    f"""WITH logits AS (SELECT doc_id, [length(text) % 7, length(text) % 5, length(text) % 3] AS l FROM documents),
e AS (SELECT doc_id, l, exp(l[1]) / (exp(l[1]) + exp(l[2]) + exp(l[3])) AS a,
      exp(l[2]) / (exp(l[1]) + exp(l[2]) + exp(l[3])) AS b, exp(l[3]) / (exp(l[1]) + exp(l[2]) + exp(l[3])) AS c FROM logits)
SELECT doc_id, {r6("a")} AS model_negative, {r6("b")} AS model_neutral, {r6("c")} AS model_positive,
       CASE WHEN l[1] >= l[2] AND l[1] >= l[3] THEN 'negative' WHEN l[2] >= l[3] THEN 'neutral' ELSE 'positive' END AS best
FROM e""",
)

TOPIC_ROWS = """logits AS (SELECT doc_id, j, (length(text) * (j + 3) % 11) / 2::DOUBLE AS l FROM documents, range(19) AS t(j)),
probs AS (SELECT doc_id, j, exp(l) / sum(exp(l)) OVER (PARTITION BY doc_id) AS p FROM logits),
names AS (SELECT unnest([{names}]) AS name, unnest(range(19)) AS j),
labels19 AS (SELECT doc_id, coalesce(string_agg('''' || name || '''', ', ' ORDER BY j) FILTER (WHERE p > 0.15), '') AS inside
  FROM probs JOIN names USING (j) GROUP BY doc_id)""".format(names=", ".join(f"'{t}'" for t in TOPICS))

add(
    "topic_probabilities",
    f"""WITH {TOPIC_ROWS},
wide AS (SELECT doc_id, {", ".join(f'''{r6(f"max(CASE WHEN j = {i} THEN p END)")} AS "{t.replace("_&_", "_and_")}"''' for i, t in enumerate(TOPICS))}
  FROM probs GROUP BY doc_id)
SELECT wide.*, '[' || inside || ']' AS label FROM wide JOIN labels19 USING (doc_id)""",
)
add(
    "topic_subset",
    f"""WITH {TOPIC_ROWS}
SELECT doc_id, {r6("p")} AS p, string_split(inside, ',')[1] AS main_label
FROM probs JOIN labels19 USING (doc_id) WHERE j = 16 AND p > 0.15""",
)
add(
    "safe_names",
    f"""WITH {TOPIC_ROWS} SELECT doc_id, replace(name, '&', '.') AS name, {r6("p")} AS p FROM probs JOIN names USING (j) WHERE name LIKE '%&%'""",
)
add(
    "extract_page_fields",
    r"""WITH f AS (
  SELECT page_id, regexp_extract_all(html, '(?s)<title[^>]*>([^<]*)</title>', 1)[1] AS title,
         regexp_extract_all(html, '(?s)<h1[^>]*>([^<]*)</h1>', 1)[1] AS heading,
         regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)[1] AS body,
         array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), '') AS links
  FROM pages)
SELECT page_id, title, heading, regexp_replace(body, '<[^>]*>', '', 'g') || links AS text
FROM f WHERE title IS NOT NULL AND heading IS NOT NULL AND body IS NOT NULL""",
)

# --- ids, search, joins ----------------------------------------------------

add(
    "id_batches",
    """SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS BIGINT) AS batch
FROM documents""",
)
add(
    "coverage_report",
    f"""SELECT source, count(l.doc_id) AS found, count(*) AS total, {r6("count(l.doc_id) / count(*)::DOUBLE")} AS ratio
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""",
)
add(
    "search_posts",
    f"""WITH {POSTS}, near AS (
  SELECT *, 2 * 3958.7613 * asin(sqrt(pow(sin(radians(40.768612 - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(40.768612)) * pow(sin(radians(-111.906879 - lon) / 2), 2))) AS miles FROM posts)
SELECT id, text, {time_text("timestamp")} AS timestamp FROM near
WHERE contains(text, 'click') AND timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-28' AND miles <= 600
ORDER BY near.timestamp DESC""",
)
add(
    "assemble_scores",
    f"""WITH {POSTS} SELECT id, username, {", ".join(f"{r6(c)} AS {c}" for c in
    ["vader_compound", "roberta_positive", "roberta_negative", "bertweet_positive", "bertweet_negative"])}, label FROM posts WHERE id % 10 NOT IN (1, 2, 3)""",
)

# --- bots ------------------------------------------------------------------

BURST = """burst AS (SELECT DISTINCT username FROM (
  SELECT username, timestamp - lag(timestamp, 4) OVER (PARTITION BY username ORDER BY timestamp, id) AS gap FROM posts)
  WHERE gap <= INTERVAL '43200 seconds')"""
VOLUME = """volume AS (SELECT DISTINCT username FROM (
  SELECT username, CAST(timestamp AS DATE) AS d, count(*) AS n FROM posts GROUP BY ALL) WHERE n > 5)"""


def frame(seconds: str) -> str:
    return (
        "PARTITION BY username ORDER BY timestamp RANGE BETWEEN CURRENT ROW AND "
        f"INTERVAL '{seconds} seconds' FOLLOWING"
    )


add(
    "forward_window_stats",
    f"""WITH {POSTS} SELECT id, count(*) OVER w AS posts, {r6("avg(vader_compound) OVER w")} AS mean
FROM posts WINDOW w AS ({frame("21599.999999")})""",
)
add(
    "forward_window_extremes",
    f"""WITH {POSTS}, v AS (SELECT id, username, timestamp,
  CAST(vader_compound * CASE id % 3 WHEN 0 THEN 1e20::DOUBLE WHEN 1 THEN 1e-15::DOUBLE ELSE 1 END AS DOUBLE) AS v FROM posts),
m AS (SELECT id, count(*) OVER w AS posts, avg(v) OVER w AS mean FROM v WINDOW w AS ({frame("21599.999999")}))
SELECT id, posts, {r6("mean * CASE WHEN abs(mean) > 1e10 THEN 1e-20::DOUBLE WHEN abs(mean) < 1e-5 THEN 1e15::DOUBLE ELSE 1 END")} AS mean FROM m""",
)
add("burst_users", f"WITH {POSTS}, {BURST} SELECT username FROM burst")
add("high_volume_users", f"WITH {POSTS}, {VOLUME} SELECT username FROM volume")
add(
    "bot_sweep",
    f"""WITH {POSTS},
stats AS (
  SELECT 21600 AS w, username, count(*) OVER a AS n, avg(vader_compound) OVER a AS m FROM posts WINDOW a AS ({frame("21599.999999")})
  UNION ALL
  SELECT 43200, username, count(*) OVER b, avg(vader_compound) OVER b FROM posts WINDOW b AS ({frame("43199.999999")})),
topic AS (SELECT username, main_label FROM (SELECT username, main_label,
    row_number() OVER (PARTITION BY username ORDER BY count(*) DESC, main_label) AS rn FROM posts GROUP BY username, main_label) WHERE rn = 1),
rules AS (SELECT * FROM (VALUES (21600), (43200)) a(w), (VALUES (1), (2), (3), (4), (5), (5000)) b(threshold)),
passed AS (SELECT r.w, r.threshold, s.username, s.m, t.main_label FROM rules r JOIN stats s ON s.w = r.w AND s.n >= r.threshold
  JOIN topic t USING (username)),
users AS (SELECT w, threshold, username, avg(m) AS m FROM passed GROUP BY ALL),
sizes AS (SELECT w, threshold, count(*) AS user_count, avg(m) AS mean_sentiment FROM users GROUP BY ALL),
tops AS (SELECT w, threshold, main_label FROM (SELECT w, threshold, main_label,
    row_number() OVER (PARTITION BY w, threshold ORDER BY count(*) DESC, main_label) AS rn FROM passed GROUP BY w, threshold, main_label) WHERE rn = 1)
SELECT CAST(r.w AS BIGINT) AS time_window, CAST(r.threshold AS BIGINT) AS threshold, coalesce(user_count, 0) AS user_count,
       {r6("mean_sentiment")} AS mean_sentiment, main_label AS main_topic
FROM rules r LEFT JOIN sizes s ON r.w = s.w AND r.threshold = s.threshold LEFT JOIN tops t ON r.w = t.w AND r.threshold = t.threshold""",
)
add(
    "flagged_users",
    f"""WITH {POSTS}, {BURST}, {VOLUME} SELECT username, 'burst' AS rule FROM burst UNION ALL SELECT username, 'day' FROM volume""",
)
add(
    "humans_anti",
    f"""WITH {POSTS}, {BURST}, {VOLUME} SELECT id, username FROM posts p
WHERE NOT EXISTS (SELECT 1 FROM burst b WHERE b.username = p.username) AND NOT EXISTS (SELECT 1 FROM volume v WHERE v.username = p.username)""",
)
add(
    "bots_semi_means",
    f"""WITH {POSTS}, {BURST} SELECT {r6("avg(vader_compound)")} AS vader_compound, {r6("avg(roberta_positive)")} AS roberta_positive,
{r6("avg(bertweet_negative)")} AS bertweet_negative, count(*) AS posts FROM posts WHERE username IN (SELECT username FROM burst)""",
)
add(
    "bots_union_zscore",
    f"""WITH {POSTS}, {BURST}, {VOLUME}, b AS (
  SELECT id, pm25, vader_compound FROM posts WHERE username IN (SELECT username FROM burst)
  UNION ALL SELECT id, pm25, vader_compound FROM posts WHERE username IN (SELECT username FROM volume))
SELECT id, {r6(z("pm25", ""))} AS pm25, {r6(z("vader_compound", ""))} AS vader_compound FROM b""",
)
add(
    "top_topic_per_user",
    f"""WITH {POSTS} SELECT username, main_label AS label FROM (SELECT username, main_label,
    row_number() OVER (PARTITION BY username ORDER BY count(*) DESC, main_label) AS rn FROM posts GROUP BY username, main_label) WHERE rn = 1""",
)
add("distinct_users", f"WITH {POSTS} SELECT DISTINCT username FROM posts")

# --- time, bins, filters ---------------------------------------------------

add(
    "local_time_features",
    f"""WITH {COUNTY}, zoned AS (SELECT *, CAST(floor((lon + 125.0037) / 11.8) AS INTEGER) AS strip FROM county_posts),
named AS (SELECT *, ['America/New_York', 'America/Chicago', 'America/Denver', 'America/Los_Angeles', 'America/Phoenix'][strip + 1] AS timezone
  FROM zoned WHERE strip BETWEEN 0 AND 4),
local AS (SELECT *, timezone(timezone, timezone('UTC', timestamp)) AS lt, timezone(timezone, timezone('UTC', time_bin)) AS lb FROM named)
SELECT id, timezone, {time_text("lt")} AS local_time, {time_text("lb")} AS local_timebin, {date_text("lt")} AS date,
       CAST(dayofweek(lt) AS BIGINT) AS day, CAST(hour(lt) AS BIGINT) AS day_hour, {bins("pm25", POLLUTION)} AS pm25_cat, main_label
FROM local""",
)
add(
    "hour_bins_in_range",
    f"""SELECT {time_text("b")} AS time_bin, count(*) AS posts FROM (
  SELECT CASE WHEN ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' THEN date_trunc('hour', ts) END AS b FROM events)
GROUP BY b""",
)
add("cut_bins_hist", f"WITH {POSTS} SELECT {bins('pm25', POLLUTION)} AS pm25_cat, count(*) AS count FROM posts GROUP BY 1")
add(
    "coarse_bins_hist",
    f"WITH {POSTS}, s AS (SELECT pm25 * 2 - 3 AS v FROM posts) SELECT {bins('v', COARSE)} AS pm25_cat, count(*) AS count FROM s GROUP BY 1",
)
add(
    "users_per_bin",
    f"WITH {POSTS} SELECT {bins('pm25', POLLUTION)} AS pm25_cat, count(DISTINCT username) AS users FROM posts GROUP BY 1",
)
add(
    "binned_crosstab",
    f"""WITH {POSTS} SELECT {bins("percent_score", TENTHS)} AS roberta_cat, {bins("bertweet_positive", TENTHS)} AS bertweet_cat,
count(*) AS count FROM posts GROUP BY 1, 2""",
)
add(
    "interval_label_sort",
    f"""WITH {POSTS}, named AS (SELECT {bins("pm25", POLLUTION)} AS name FROM posts), c AS (SELECT name, count(*) AS count FROM named GROUP BY 1)
SELECT name, count, TRY_CAST(regexp_extract(name, '^.([^,]*),', 1) AS DOUBLE) AS start,
       CASE WHEN name LIKE '%Inf]' THEN NULL ELSE TRY_CAST(regexp_extract(name, ',([^,]*).$', 1) AS DOUBLE) END AS end
FROM c ORDER BY start NULLS LAST, 4 NULLS LAST""",
)
add(
    "filter_regions_dates",
    f"""WITH {COUNTY} SELECT id, CNTY_UNIQUE, {date_text("date")} AS date FROM county_posts
WHERE NAME NOT IN ('NATION_3', 'NATION_7') AND CNTY_UNIQUE LIKE '%AM%' AND county_posts.date BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'
AND vader_compound <> 0 AND pm25 < 75""",
)

# --- descriptives ----------------------------------------------------------


def stats(column: str) -> str:
    return f"""count(*) AS count, {r6(f"avg({column})")} AS mean,
{r6(f"CASE WHEN count({column}) = count(*) THEN avg({column}) END")} AS mean_strict, {r6(f"min({column})")} AS min,
{r6(f"max({column})")} AS max, {r6(f"quantile_cont({column}, 0.5)")} AS median"""


def six(column: str, name: str) -> str:
    return f"""'{name}' AS variable, {r6(f"min({column})")} AS min, {r6(f"quantile_cont({column}, 0.25)")} AS q1,
{r6(f"quantile_cont({column}, 0.5)")} AS median, {r6(f"avg({column})")} AS mean, {r6(f"quantile_cont({column}, 0.75)")} AS q3,
{r6(f"max({column})")} AS max, {r6(f"stddev_samp({column})")} AS sd, count(*) - count({column}) AS missing"""


add(
    "group_stats",
    f"""WITH {POSTS}, m AS (SELECT username, CASE WHEN id % 97 <> 0 OR user_id % 2 = 0 THEN pm25 END AS v FROM posts)
SELECT username, {stats("v")} FROM m GROUP BY username""",
)
add("group_stats_heavy", f"WITH {POSTS} SELECT main_label AS label, {stats('pm25')} FROM posts GROUP BY main_label")
add(
    "summary_stats",
    f"""WITH {POSTS}, m AS (SELECT CASE WHEN id % 10 <> 0 THEN pm25 END AS pm25, vader_compound, temperature FROM posts)
SELECT {six("pm25", "pm25")} FROM m UNION ALL SELECT {six("vader_compound", "vader_compound")} FROM m
UNION ALL SELECT {six("temperature", "temperature")} FROM m""",
)
add(
    "summary_posts_per_user",
    f"WITH {POSTS}, m AS (SELECT username, count(*)::DOUBLE AS c FROM posts GROUP BY username) SELECT {six('c', 'count')} FROM m",
)
def corr_rows(names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS r FROM posts" for a in names for b in names
    )


add("corr_matrix", f"WITH {POSTS} {corr_rows(SENTIMENTS)}")
add("corr_matrix_standardized", f"WITH {POSTS} {corr_rows(SENTIMENTS[:3])}")
add(
    "grouped_corr",
    f"""WITH {COUNTY}, g AS (SELECT count(*) AS n, avg(pm25) AS m FROM county_posts GROUP BY time_bin, STATE_NAME)
SELECT {r6("corr(n, m)")} AS r, count(*) AS groups FROM g""",
)
add(
    "mean_se",
    f"""WITH {COUNTY} SELECT CNTY_UNIQUE, {r6("avg(vader_compound)")} AS mean,
{r6("stddev_samp(vader_compound) / sqrt(count(vader_compound))")} AS se, count(vader_compound) AS n FROM county_posts GROUP BY CNTY_UNIQUE""",
)
SUMMARY = f"""summary AS (SELECT NAME, count(*) AS num_tweets, avg(pm25) AS mean_pollution, max(pm25) AS max_pollution,
{", ".join(f"avg({s}) AS mean_{s}" for s in SENTIMENTS)}, quantile_cont(pm25, 0.5) AS median_pollution FROM county_posts GROUP BY NAME)"""
add(
    "region_summary",
    f"""WITH {COUNTY}, {SUMMARY} SELECT NAME, num_tweets, {", ".join(f"{r6(c)} AS {c}" for c in
    ["mean_pollution", "max_pollution", "median_pollution", *[f"mean_{s}" for s in SENTIMENTS]])} FROM summary""",
)
add(
    "region_population",
    f"""WITH {COUNTY}, {SUMMARY}, heads AS (SELECT c_nationkey, count(*) AS p FROM customer GROUP BY 1)
SELECT n_name AS NAME, p::DOUBLE AS POP2010, num_tweets::DOUBLE AS num_tweets, {r6("num_tweets / p::DOUBLE")} AS tweets_pc, {r6("log10(num_tweets)")} AS log10_tweets,
       {r6("ln(num_tweets / p::DOUBLE)")} AS ln_tweets_pc
FROM nation LEFT JOIN heads ON n_nationkey = c_nationkey LEFT JOIN summary ON n_name = NAME AND NAME <> 'NATION_4'""",
)
add("regions_over_limit", f"WITH {COUNTY}, {SUMMARY} SELECT count(*) AS regions FROM summary WHERE mean_pollution > 9.5")
add(
    "hourly_series",
    f"""WITH {COUNTY} SELECT {time_text("time_bin")} AS time_bin, count(*) AS count, {r6("max(pm25)")} AS pm25,
{r6("avg(vader_compound)")} AS sentiment FROM county_posts GROUP BY county_posts.time_bin""",
)
add(
    "hourly_series_topic",
    f"""WITH {COUNTY} SELECT {time_text("time_bin")} AS time_bin, count(*) AS count, {r6("avg(pm25)")} AS pm25
FROM county_posts WHERE main_label = '''click''' GROUP BY county_posts.time_bin""",
)
add(
    "weekday_profile_diff",
    f"""WITH {COUNTY}, s AS (SELECT dayofweek(date) AS day, {z("roberta_positive", "")} AS a, {z("bertweet_positive", "")} AS b,
  {z("vader_compound", "")} AS c FROM county_posts),
m AS (SELECT day, 'RoBERTa' AS variable, avg(a) AS value FROM s GROUP BY day UNION ALL SELECT day, 'BERTweet', avg(b) FROM s GROUP BY day
  UNION ALL SELECT day, 'VADER', avg(c) FROM s GROUP BY day),
l AS (SELECT *, lag(value) OVER (PARTITION BY variable ORDER BY day) AS lag FROM m)
SELECT CAST(day AS BIGINT) AS day, ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][day + 1] AS day_name, variable, {r6("value")} AS value,
       {r6("l.lag")} AS lag, {r6("value - l.lag")} AS diff FROM l""",
)
add(
    "response_curve",
    f"""WITH {POSTS} SELECT CAST(round_even(pm25, 0) AS BIGINT) AS int_pm, {", ".join(f"{r6(f'avg({c})')} AS {c}" for c in
    ["vader_compound", "roberta_positive", "bertweet_positive"])} FROM posts WHERE pm25 < 75 GROUP BY 1""",
)


def study(start: str, stop: str, where: str) -> str:
    scaled = ", ".join(f"{z(s, '')} AS {s}" for s in SENTIMENTS[1:])
    return f"""WITH {COUNTY}, s AS (SELECT date, main_label, CNTY_UNIQUE, {scaled} FROM county_posts),
d AS (SELECT date, (avg(roberta_positive) + avg(bertweet_positive)) / 2 AS p, (avg(roberta_negative) + avg(bertweet_negative)) / 2 AS n
  FROM s WHERE date BETWEEN DATE '{start}' AND DATE '{stop}' AND {where} GROUP BY date)
SELECT {date_text("date")} AS date, 'Positive' AS variable, {r6("p")} AS value FROM d
UNION ALL SELECT {date_text("date")}, 'Negative', {r6("n")} FROM d"""


add("event_study_topic", study("2024-01-03", "2024-01-11", "main_label = '''view'''"))
add("event_study_place", study("2024-01-10", "2024-01-20", "contains(CNTY_UNIQUE, 'ASIA')"))
add(
    "sample_n",
    f"""WITH {POSTS} SELECT id, username FROM posts
ORDER BY substr(md5('s' || CAST(id AS VARCHAR)), 1, 15), id LIMIT 500""",
)

# --- grid ------------------------------------------------------------------

WIDE = f"""{POSTS}, slots AS (SELECT id % 20 AS id, hour(timestamp) // 3 AS slot, max(user_id * 3 + id % 7) + 0.5::DOUBLE AS pm25 FROM posts GROUP BY ALL),
cells AS (SELECT DISTINCT id FROM slots),
wide AS (SELECT c.id, t.slot, TIMESTAMP '2024-01-02' + t.slot * INTERVAL '3 hours' AS moment, pm25
  FROM cells c CROSS JOIN range(8) AS t(slot) LEFT JOIN slots s ON s.id = c.id AND s.slot = t.slot)"""
add("grid_long", f"WITH {WIDE} SELECT id, {time_text('moment')} AS timestamp, pm25 FROM wide")
add("wide_grid_midnight", f"WITH {WIDE} SELECT id, {time_text('moment')} AS timestamp, pm25 FROM wide WHERE slot = 0")

SERIES = f"""{POSTS}, long AS (
  SELECT id % 20 AS id, date_trunc('day', timestamp) + (hour(timestamp) // 3) * INTERVAL '3 hours' AS moment, {", ".join(GRID_VARIABLES)} FROM posts),
series AS ({" UNION ALL ".join(f"SELECT id, '{v}' AS variable, moment, avg({v}) AS value FROM long GROUP BY id, moment" for v in GRID_VARIABLES)})"""
HOURLY = f"""{SERIES}, knots AS (SELECT id, variable, moment, value,
    lead(moment) OVER (PARTITION BY id, variable ORDER BY moment) AS nat, lead(value) OVER (PARTITION BY id, variable ORDER BY moment) AS nv FROM series),
steps AS (SELECT *, unnest(CASE WHEN nat IS NULL THEN [0] ELSE range(CAST(epoch(nat - moment) AS BIGINT) // 3600) END) AS h FROM knots),
hourly AS (SELECT id, variable, moment + h * INTERVAL '1 hour' AS moment,
    CASE WHEN nat IS NULL THEN value ELSE value + (nv - value) / epoch(nat - moment) * (h * 3600) END AS value FROM steps)"""
add(
    "grid_units",
    f"""WITH {SERIES} SELECT id, variable, {time_text("moment")} AS timestamp,
{r6("CASE variable WHEN 'pm25' THEN value / 1e9 * 1e9 WHEN 'precipitation' THEN value * 1e3 WHEN 'temperature' THEN value - 272.15::DOUBLE WHEN 'dewpoint' THEN value - 272.15::DOUBLE ELSE value END")} AS value FROM series""",
)
add(
    "grid_slice",
    f"""WITH {SERIES} SELECT id, {time_text("moment")} AS timestamp, {r6("value")} AS value FROM series
WHERE variable = 'pm25' AND moment BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07 21:00:00'""",
)
add(
    "interpolate_hourly",
    f"WITH {HOURLY} SELECT id, variable, {time_text('moment')} AS timestamp, {r6('value')} AS value FROM hourly",
)
add(
    "interpolate_off_step",
    f"""WITH {SERIES}, knots AS (SELECT id, variable, moment + INTERVAL 7 MINUTE AS t, value,
    lead(moment + INTERVAL 7 MINUTE) OVER w AS nt, lead(value) OVER w AS nv FROM series WINDOW w AS (PARTITION BY id, variable ORDER BY moment)),
steps AS (SELECT *, unnest(generate_series(date_trunc('hour', t) + INTERVAL 1 HOUR, nt, INTERVAL 1 HOUR)) AS h FROM knots WHERE nt IS NOT NULL)
SELECT id, variable, {time_text("h")} AS timestamp, {r6("value + (nv - value) * epoch(h - t) / epoch(nt - t)")} AS value FROM steps WHERE h < nt""",
)
CELL = "CAST(floor((lat - 24) / 6.5) * 5 + floor((lon + 125) / 11.8) AS BIGINT)"
add(
    "grid_attach",
    f"""WITH {HOURLY}, placed AS (SELECT id, {CELL} AS id_geo, date_trunc('hour', timestamp) AS time_bin FROM posts),
wide AS (SELECT id AS id_geo, moment, {", ".join(f"max(CASE WHEN variable = '{v}' THEN value END) AS {v}" for v in GRID_VARIABLES)}
  FROM hourly GROUP BY id, moment)
SELECT p.id, p.id_geo, {", ".join(f"{r6(f'w.{v}')} AS {v}" for v in GRID_VARIABLES)}
FROM placed p LEFT JOIN wide w ON w.id_geo = p.id_geo AND w.moment = p.time_bin""",
)
add("cell_mean", f"WITH {SERIES} SELECT id, {r6('avg(value)')} AS mean_value FROM series WHERE variable = 'pm25' GROUP BY id")

# --- space -----------------------------------------------------------------

EDGES = """corners AS (
  SELECT n_name AS NAME, -125.0037::DOUBLE + 11.8::DOUBLE * (n_nationkey % 5) AS x, 23.9963::DOUBLE + 5.2::DOUBLE * (n_nationkey // 5) AS y,
         n_nationkey % 2 = 0 AS holed FROM nation),
outline AS (SELECT * FROM (VALUES (0, 0::DOUBLE, 0::DOUBLE, 11.8::DOUBLE, 0::DOUBLE), (0, 11.8, 0, 11.8, 5.2), (0, 11.8, 5.2, 5.9, 3.1),
  (0, 5.9, 3.1, 0, 5.2), (0, 0, 5.2, 0, 0), (1, 2, 1, 2, 2), (1, 2, 2, 3, 2), (1, 3, 2, 3, 1), (1, 3, 1, 2, 1)) t(hole, a, b, c, d)),
edges AS (SELECT NAME, hole, round(x + a, 4) AS x1, round(y + b, 4) AS y1, round(x + c, 4) AS x2, round(y + d, 4) AS y2
  FROM corners, outline WHERE hole = 0 OR holed)"""
INSIDE = f"""{EDGES}, crossings AS (
  SELECT p.id, e.NAME FROM posts p JOIN edges e ON (e.y1 > p.lat) <> (e.y2 > p.lat)
   AND p.lon < e.x1 + (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1)),
inside AS (SELECT id, NAME FROM crossings GROUP BY id, NAME HAVING count(*) % 2 = 1)"""
add("points_in_regions", f"WITH {POSTS}, {INSIDE} SELECT id, NAME FROM inside")
add("points_in_regions_left", f"WITH {POSTS}, {INSIDE} SELECT id, NAME FROM posts LEFT JOIN inside USING (id)")
add(
    "assign_grid_cell",
    f"""WITH {POSTS}, moved AS (SELECT id, lon - 3 AS lon, lat FROM posts)
SELECT id, CASE WHEN lon >= -125 AND floor((lon + 125) / 11.8) < 5 AND floor((lat - 24) / 6.5) BETWEEN 0 AND 3 THEN {CELL} END::DOUBLE AS id_geo FROM moved""",
)
add(
    "spatiotemporal_join",
    f"""WITH {SERIES}, placed AS (SELECT id, {CELL} AS id_geo, date_trunc('day', timestamp) + (hour(timestamp) // 3) * INTERVAL '3 hours' AS moment FROM posts)
SELECT p.id, p.id_geo, {r6("s.value")} AS pm25 FROM placed p JOIN series s ON s.id = p.id_geo AND s.moment = p.moment WHERE s.variable = 'pm25'""",
)
PIECES = f"""{EDGES},
boxes AS (SELECT iy * 31 + ix AS id_geo, -126 + 2::DOUBLE * ix AS bx0, -126 + 2::DOUBLE * (ix + 1) AS bx1,
   23 + 1.5::DOUBLE * iy AS by0, 23 + 1.5::DOUBLE * (iy + 1) AS by1 FROM range(31) a(ix), range(19) b(iy)),
part AS (SELECT e.NAME, b.id_geo, by0, by1, least(greatest(x1, bx0), bx1) AS xa, least(greatest(x2, bx0), bx1) AS xb, x1, y1,
   CASE WHEN x1 = x2 THEN 0 ELSE (y2 - y1) / (x2 - x1) END AS slope FROM edges e JOIN boxes b ON least(x1, x2) < bx1 AND greatest(x1, x2) > bx0),
lines AS (SELECT NAME, id_geo, by1 - by0 AS h, xb - xa AS run, y1 + slope * (xa - x1) - by0 AS ua, y1 + slope * (xb - x1) - by0 AS ub FROM part),
sums AS (SELECT NAME, id_geo, abs(sum(run * CASE WHEN abs(ub - ua) < 1e-12 THEN greatest(least((ua + ub) / 2, h), 0)
   ELSE ((CASE WHEN ub < 0 THEN 0 WHEN ub < h THEN ub * ub / 2 ELSE h * h / 2 + h * (ub - h) END)
       - (CASE WHEN ua < 0 THEN 0 WHEN ua < h THEN ua * ua / 2 ELSE h * h / 2 + h * (ua - h) END)) / (ub - ua) END)) AS area
   FROM lines GROUP BY NAME, id_geo),
cells AS (SELECT CAST(floor((lat - 23) / 1.5) * 31 + floor((lon + 126) / 2) AS BIGINT) AS id_geo, avg(pm25) AS pm25 FROM posts GROUP BY 1)"""
add(
    "overlay_grid_regions",
    f"""WITH {POSTS}, {PIECES}
SELECT NAME, count(*) AS pieces, {r6("sum(area)")} AS area, {r6("sum(area * pm25) / sum(CASE WHEN pm25 IS NOT NULL THEN area END)")} AS pm25
FROM sums LEFT JOIN cells USING (id_geo) WHERE area > 1e-12 GROUP BY NAME""",
)
add(
    "overlay_pieces",
    f"""WITH {POSTS}, {PIECES}
SELECT NAME, id_geo, {r6("area")} AS area, {r6("area / 3")} AS share, true AS inside, {r6("pm25")} AS pm25
FROM sums LEFT JOIN cells USING (id_geo) WHERE area > 1e-12""",
)
ALBERS = """k AS (SELECT sqrt(2 * f - f * f) AS e FROM (SELECT 1 / 298.257222101::DOUBLE AS f)),
ang AS (SELECT e, radians(29.5::DOUBLE) AS p1, radians(45.5::DOUBLE) AS p2, radians(23::DOUBLE) AS p0 FROM k),
q AS (SELECT *, cos(p1) / sqrt(1 - e * e * sin(p1) * sin(p1)) AS m1, cos(p2) / sqrt(1 - e * e * sin(p2) * sin(p2)) AS m2,
  (1 - e * e) * (sin(p1) / (1 - e * e * sin(p1) * sin(p1)) - ln((1 - e * sin(p1)) / (1 + e * sin(p1))) / (2 * e)) AS q1,
  (1 - e * e) * (sin(p2) / (1 - e * e * sin(p2) * sin(p2)) - ln((1 - e * sin(p2)) / (1 + e * sin(p2))) / (2 * e)) AS q2,
  (1 - e * e) * (sin(p0) / (1 - e * e * sin(p0) * sin(p0)) - ln((1 - e * sin(p0)) / (1 + e * sin(p0))) / (2 * e)) AS q0 FROM ang),
n AS (SELECT *, (m1 * m1 - m2 * m2) / (q2 - q1) AS n FROM q),
c AS (SELECT *, m1 * m1 + n * q1 AS c FROM n),
proj AS (SELECT id, 6378137 * sqrt(c - n * (1 - e * e) * (sin(radians(lat)) / (1 - e * e * sin(radians(lat)) * sin(radians(lat)))
    - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e))) / n AS rho,
  n * radians(lon + 96) AS theta, 6378137 * sqrt(c - n * q0) / n AS rho0 FROM posts, c),
flat AS (SELECT id, rho * sin(theta) AS x, rho0 - rho * cos(theta) AS y FROM proj)"""
add("project_albers", f"WITH {POSTS}, {ALBERS} SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM flat")
add(
    "density_grid",
    f"""WITH {POSTS}, {ALBERS} SELECT CAST(floor(x / 100000) AS BIGINT) AS ix, CAST(floor(y / 100000) AS BIGINT) AS iy,
count(*) AS points FROM flat GROUP BY 1, 2""",
)
add(
    "points_wkt",
    f"WITH {POSTS} SELECT id, 'POINT (' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS wkt FROM posts",
)
add(
    "regions_from_wkt",
    f"""WITH {POSTS}, {INSIDE}, counts AS (SELECT NAME, count(*) AS posts FROM inside GROUP BY NAME),
layer AS (SELECT NAME, CAST(max(hole) + 1 AS BIGINT) AS n_rings, min(least(x1, x2)) AS min_x, max(greatest(x1, x2)) AS max_x,
  min(least(y1, y2)) AS min_y, max(greatest(y1, y2)) AS max_y, sum(x1 * y2 - x2 * y1) / 2 AS area FROM edges GROUP BY NAME)
SELECT NAME, n_rings, {", ".join(f"{r6(c)} AS {c}" for c in ["min_x", "max_x", "min_y", "max_y", "area"])}, posts
FROM layer LEFT JOIN counts USING (NAME)""",
)

# --- regressions -----------------------------------------------------------

ORDERS = """lines AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1),
op AS (SELECT o_orderkey, o_totalprice / 1000::DOUBLE AS y, c_acctbal / 1000::DOUBLE AS x1,
   o_totalprice / 2000::DOUBLE + o_orderkey % 13 AS endog, (o_orderkey % 13)::DOUBLE AS z1, (o_orderkey % 29)::DOUBLE AS z2,
   c_nationkey AS nation, CAST(o_orderdate AS DATE) AS date, o_orderstatus, (coalesce(c, 0) + 1)::DOUBLE AS w
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lines ON o_orderkey = l_orderkey)"""

add(
    "ols",
    f"""WITH {ORDERS}, d AS (SELECT y - avg(y) OVER () AS y, x1 - avg(x1) OVER () AS a, x1 * x1 - avg(x1 * x1) OVER () AS b,
   avg(y) OVER () AS my, avg(x1) OVER () AS ma, avg(x1 * x1) OVER () AS mb FROM op),
s AS (SELECT count(*) AS n, any_value(my) AS my, any_value(ma) AS ma, any_value(mb) AS mb, sum(a * a) AS aa, sum(a * b) AS ab,
   sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb, sum(y * y) AS yy FROM d),
c AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM s),
v AS (SELECT *, (yy - ba * ay - b2 * yb) / (n - 3) AS s2 FROM c)
SELECT 'y' AS outcome, '(Intercept)' AS term, {r6("my - ma * ba - mb * b2")} AS estimate,
   {r6("sqrt(s2 * (1 / n::DOUBLE + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det))")} AS se, n FROM v
UNION ALL SELECT 'y', 'x1', {r6("ba")}, {r6("sqrt(s2 * bb / det)")}, n FROM v
UNION ALL SELECT 'y', 'x1_sq', {r6("b2")}, {r6("sqrt(s2 * aa / det)")}, n FROM v""",
)


def oneway(rows: str, y: str, x: str, effect: str, weight: str = "1", outcome: str | None = None, term: str | None = None) -> str:
    """Within slope of one regressor; classical error."""
    return f"""SELECT '{outcome or y}' AS outcome, '{term or x}' AS term, {r6("xy / xx")} AS estimate,
   {r6("sqrt((yy - xy * xy / xx) / (n - 1 - levels) / xx)")} AS se, n FROM (
  SELECT count(*) AS n, count(DISTINCT {effect}) AS levels, sum(y * x) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM (
    SELECT {effect}, {y} - avg({y}) OVER (PARTITION BY {effect}) AS y, {x} - avg({x}) OVER (PARTITION BY {effect}) AS x FROM {rows}))"""


add(
    "ols_absorb_instant",
    f"""WITH {POSTS}, r AS (SELECT *, date_trunc('hour', timestamp) AS instant FROM posts WHERE vader_compound <> 0)
{oneway("r", "roberta_positive", "pm25", "instant")}""",
)
add(
    "two_stage_ls",
    # instruments made orthogonal step by step, so projections are plain sums
    f"""WITH {ORDERS}, d AS (SELECT y - avg(y) OVER () AS y, x1 - avg(x1) OVER () AS x, endog - avg(endog) OVER () AS e,
   z1 - avg(z1) OVER () AS z1, z2 - avg(z2) OVER () AS z2 FROM op),
a AS (SELECT y - x * (sum(x * y) OVER () / sum(x * x) OVER ()) AS y, e - x * (sum(x * e) OVER () / sum(x * x) OVER ()) AS e,
   z1 - x * (sum(x * z1) OVER () / sum(x * x) OVER ()) AS z1, z2 - x * (sum(x * z2) OVER () / sum(x * x) OVER ()) AS z2 FROM d),
b AS (SELECT y, e, z1, z2 - z1 * (sum(z1 * z2) OVER () / sum(z1 * z1) OVER ()) AS z2 FROM a),
f AS (SELECT y, e, z1 * (sum(z1 * e) OVER () / sum(z1 * z1) OVER ()) + z2 * (sum(z2 * e) OVER () / sum(z2 * z2) OVER ()) AS fit FROM b)
SELECT 'y' AS outcome, 'endog' AS term, {r6("sum(fit * y) / sum(fit * e)")} AS estimate,
   {r6("sqrt((sum(y * y) - 2 * sum(fit * y) / sum(fit * e) * sum(y * e) + pow(sum(fit * y) / sum(fit * e), 2) * sum(e * e)) / (count(*) - 3) / sum(fit * fit))")} AS se,
   count(*) AS n FROM f""",
)
add("fe_oneway", f"""WITH {ORDERS} {oneway("op", "y", "x1", "nation")} UNION ALL {oneway("op", "z2", "x1", "nation")}""")


def clustered(rows: str, weight: str) -> str:
    """Within slope and one-way clustered error, effect and cluster being the nation."""
    return f"""SELECT n, groups, xy / xx AS b, xx FROM (SELECT count(*) AS n, count(DISTINCT nation) AS groups, sum(w * x * y) AS xy,
   sum(w * x * x) AS xx FROM {rows})"""


WITHIN = """within AS (SELECT nation, {w} AS w, y - sum({w} * y) OVER g / sum({w}) OVER g AS y, x1 - sum({w} * x1) OVER g / sum({w}) OVER g AS x
  FROM {rows} WINDOW g AS (PARTITION BY nation))"""
add(
    "fe_cluster_se",
    f"""WITH {ORDERS}, {WITHIN.format(w="w", rows="op")}, fit AS ({clustered("within", "w")}),
u AS (SELECT nation, sum(w * x * (y - b * x)) AS u FROM within, fit GROUP BY nation)
SELECT 'y' AS outcome, 'x1' AS term, {r6("any_value(b)")} AS estimate,
   {r6("sqrt(sum(u * u) / any_value(xx * xx) * any_value(groups / (groups - 1)::DOUBLE) * any_value((n - 1) / (n - 2)::DOUBLE))")} AS se,
   any_value(n) AS n FROM u, fit""",
)


def sweeps(first: str, effects: list[str], columns: list[str], rounds: int) -> str:
    """Alternating weighted demeaning, written out."""
    out, last = [], first
    keep = ", ".join([*effects, "w"])
    for i in range(rounds):
        for j, e in enumerate(effects):
            name = f"s{i}_{j}"
            demeaned = ", ".join(f"{c} - sum(w * {c}) OVER g / sum(w) OVER g AS {c}" for c in columns)
            out.append(f"{name} AS MATERIALIZED (SELECT {keep}, {demeaned} FROM {last} WINDOW g AS (PARTITION BY {e}))")
            last = name
    return ",\n".join(out) + f",\nswept AS (SELECT * FROM {last})"


add(
    "fe_multiway",
    f"""WITH {ORDERS}, {sweeps("op", ["nation", "date"], ["y", "x1"], 40)},
fit AS (SELECT sum(w * x1 * y) / sum(w * x1 * x1) AS b, sum(w * x1 * x1) AS xx, count(*) AS n,
   least(count(DISTINCT nation), count(DISTINCT date)) AS g FROM swept),
u AS (SELECT nation, date, sum(w * x1 * (y - b * x1)) AS u FROM swept, fit GROUP BY nation, date),
v AS (SELECT (SELECT sum(s * s) FROM (SELECT sum(u) AS s FROM u GROUP BY nation))
   + (SELECT sum(s * s) FROM (SELECT sum(u) AS s FROM u GROUP BY date)) - (SELECT sum(u * u) FROM u) AS v)
SELECT 'y' AS outcome, 'x1' AS term, {r6("b")} AS estimate,
   {r6("sqrt(v / (xx * xx) * g / (g - 1)::DOUBLE * (n - 1) / (n - 2)::DOUBLE)")} AS se, n FROM fit, v""",
)


def bin_effects(rounds: int) -> str:
    """Two-way additive fit of bins and counties, by alternating means of residuals."""
    out = [
        "b0 AS (SELECT bin, 0::DOUBLE AS a FROM cells GROUP BY bin)",
    ]
    for i in range(rounds):
        out.append(
            f"c{i} AS MATERIALIZED (SELECT CNTY_UNIQUE, sum(s - n * a) / sum(n) AS c FROM cells JOIN b{i} USING (bin) GROUP BY CNTY_UNIQUE)"
        )
        out.append(
            f"b{i + 1} AS MATERIALIZED (SELECT bin, sum(s - n * c) / sum(n) AS a FROM cells JOIN c{i} USING (CNTY_UNIQUE) GROUP BY bin)"
        )
    return ",\n".join(out) + f", bin_fit AS (SELECT * FROM b{rounds})"


BIN_FIT = f"""{COUNTY}, cells AS (SELECT {bins("pm25", POLLUTION)} AS bin, CNTY_UNIQUE, count(*) AS n, sum(roberta_positive) AS s
  FROM county_posts GROUP BY 1, 2), {bin_effects(30)},
base AS (SELECT a AS a0 FROM bin_fit WHERE bin = '[0,5]'), total AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM cells)"""
add(
    "fe_pm_bins",
    f"""WITH {BIN_FIT} SELECT 'roberta_positive' AS outcome, 'pm25_cat' || bin AS term, {r6("a - a0")} AS estimate, n
FROM bin_fit, base, total WHERE bin <> '[0,5]'""",
)
add(
    "coef_table",
    f"""WITH {BIN_FIT} SELECT 'roberta_positive' AS outcome, bin AS interval,
   CAST(CASE WHEN bin = '[0,5]' THEN 0 ELSE CAST(regexp_extract(bin, '^.([0-9]+),', 1) AS INTEGER) // 5 END AS BIGINT) AS position,
   {r6("a - a0")} AS estimate, n FROM bin_fit, base, total""",
)


def subset(name: str, where: str) -> str:
    return f"""SELECT '{name}' AS subset, 'y' AS outcome, 'x1' AS term, {r6("any_value(b)")} AS estimate,
   {r6("sqrt(sum(u * u) / any_value(xx * xx) * count(*) / (count(*) - 1)::DOUBLE * any_value((n - 1) / (n - 2)::DOUBLE))")} AS se, any_value(n) AS n
FROM (SELECT nation, sum(x * (y - b * x)) AS u, any_value(b) AS b, any_value(xx) AS xx, any_value(n) AS n FROM (
  SELECT *, sum(x * y) OVER () / sum(x * x) OVER () AS b, sum(x * x) OVER () AS xx, count(*) OVER () AS n FROM (
    SELECT nation, y - avg(y) OVER (PARTITION BY nation) AS y, x1 - avg(x1) OVER (PARTITION BY nation) AS x FROM op WHERE {where}))
  GROUP BY nation)"""


add(
    "robustness_suite",
    f"""WITH {ORDERS} {subset("all", "true")} UNION ALL {subset("finished", "o_orderstatus = 'F'")}
UNION ALL {subset("without_two", "nation NOT IN (3, 7)")}""",
)
add(
    "loess_curve",
    f"""WITH {POSTS}, p AS (SELECT main_label AS series, CASE WHEN pm25 <= 5 THEN 0 WHEN pm25 > 70 THEN 14 ELSE CAST(ceil(pm25 / 5) AS INTEGER) - 1 END AS x,
   avg(vader_compound) AS v FROM posts GROUP BY 1, 2),
q AS (SELECT series, CAST(floor(count(*) * 0.75 + 1e-5) AS INTEGER) AS q FROM p GROUP BY series),
near AS (SELECT a.series, a.x AS x0, a.v AS v0, b.x - a.x AS t, b.v AS v, abs(b.x - a.x) AS d,
   row_number() OVER (PARTITION BY a.series, a.x ORDER BY abs(b.x - a.x)) AS rn FROM p a JOIN p b ON a.series = b.series),
reach AS (SELECT series, x0, d AS h FROM near JOIN q USING (series) WHERE rn = q),
w AS (SELECT near.*, CASE WHEN d < h THEN pow(1 - pow(d / h::DOUBLE, 3), 3) ELSE 0 END AS w FROM near JOIN reach USING (series, x0)),
s AS (SELECT series, x0, any_value(v0) AS v0, sum(w) AS s0, sum(w * t) AS s1, sum(w * t * t) AS s2, sum(w * t * t * t) AS s3, sum(w * t * t * t * t) AS s4,
   sum(w * v) AS t0, sum(w * t * v) AS t1, sum(w * t * t * v) AS t2 FROM w GROUP BY series, x0)
SELECT series, x0::DOUBLE AS position, {r6("v0")} AS value, 1::BIGINT AS n,
   {r6("(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))")} AS smooth
FROM s""",
)
