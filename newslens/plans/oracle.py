"""SQL equivalents of the registered queries, straight from the warehouse tables.

They do not parse the packed article fields: tone, themes, countries and titles come from the
columns those fields were built from.
"""

# --- Building blocks (common table expressions) -----------------------------------

# Every line item as an article with typed fields.
ART = """art AS MATERIALIZED (
  SELECT *,
    CASE
      WHEN nation = 4 THEN CASE s_suppkey % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'GBR' END
      WHEN nation = 5 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'DEU' END
      WHEN nation = 15 THEN NULL
      ELSE iso_list[nation + 1]
    END AS iso,
    CASE
      WHEN nation = 4 AND s_suppkey % 3 = 0 THEN 'CNN.com'
      WHEN nation = 4 AND s_suppkey % 3 = 1 THEN ' theguardian.com '
      WHEN nation = 5 AND s_suppkey % 2 = 0 THEN 'faz.net'
      WHEN nation = 15 AND s_suppkey % 2 = 0 THEN NULL
      ELSE 'outlet' || (s_suppkey % 40) || '.' || tld_list[nation + 1]
    END AS source,
    CASE WHEN linenumber <> 7 THEN 'https://wire.example/news/' || CASE p_partkey % 5
      WHEN 0 THEN dashed || '-restocked'
      WHEN 1 THEN dashed || '-' || kind || '-from-brand-' || brand_no || '.html'
      WHEN 2 THEN replace(p_name, ' ', '_') || '_' || kind || '_from.brand-' || brand_no || '-'
                  || lpad(p_partkey::VARCHAR, 9, '7') || '?page=' || p_size
      WHEN 3 THEN 'caf%C3%A9-' || dashed || '-' || kind || '-' || p_size || ';s=1'
      ELSE dashed || '-' || kind || '-deadbeef0' || brand_no || '-back-in-stock/#top'
    END END AS doc,
    CASE p_partkey % 5
      WHEN 1 THEN p_name || ' ' || kind || ' from brand ' || brand_no
      WHEN 2 THEN p_name || ' ' || kind || ' from brand ' || brand_no
      WHEN 3 THEN 'café ' || p_name || ' ' || kind || ' ' || p_size
      WHEN 4 THEN p_name || ' ' || kind || ' back in stock'
    END AS words,
    CASE WHEN NOT (linenumber = 6 AND l_discount < 0.05) THEN amount END AS tone_text,
    CASE WHEN NOT (linenumber = 6 AND l_discount < 0.05) THEN amount::DOUBLE END AS tone,
    (year(date) * 10000 + month(date) * 100 + day(date))::BIGINT * 1000000
      + linenumber * 10000 + 3015 AS packed,
    CASE WHEN date < DATE '1996-07-01' THEN 0 WHEN date < DATE '1998-01-01' THEN 1
         WHEN date < DATE '1999-01-01' THEN 2 WHEN date < DATE '2000-01-01' THEN 3 ELSE 4 END AS era
  FROM (
    SELECT l.*, p.*, s.*, l_linenumber AS linenumber, CAST(l_shipdate AS DATE) AS date,
      s_nationkey AS nation, replace(p_name, ' ', '-') AS dashed, lower(p_type) AS kind,
      split_part(p_brand, '#', 2) AS brand_no, split_part(p_name, ' ', 1) AS word1,
      CAST(CAST(CAST(round((l_extendedprice - 50000.0) * 100) AS BIGINT) * 1285737123 AS DECIMAL(20,0))
        * CAST('0.000000000000001' AS DECIMAL(16,15)) AS VARCHAR) AS amount,
      ['FRA','DEU','GBR','USA',NULL,NULL,'TUV','ITA','ESP','JPN','CHN','IND','BRA','CAN','AUS',
       NULL,'TUR','KOR','UKR','RUS','POL','SWE','IRL','ZAF','MEX'] AS iso_list,
      ['fr','de','co.uk','us','com','net','tv','it','es','jp','cn','in','br','ca','au',
       'org','tr','kr','ua','ru','pl','se','ie','za','mx'] AS tld_list
    FROM lineitem l JOIN part p ON l_partkey = p_partkey JOIN supplier s ON l_suppkey = s_suppkey
  ))"""

EVENT_ART = """event_art AS MATERIALIZED (
  SELECT CAST(ts AS DATE) AS date,
    (['FRA','DEU','GBR','USA',NULL,NULL,'TUV','ITA','ESP','JPN','CHN','IND','BRA','CAN','AUS',
      NULL,'TUR','KOR','UKR','RUS','POL','SWE','IRL','ZAF','MEX'])[(user_id % 25 + 1)::INT] AS iso,
    user_id || '/' || event_type AS doc, ts,
    'daily.' || (['fr','de','co.uk','us','com','net','tv','it','es','jp','cn','in','br','ca','au',
      'org','tr','kr','ua','ru','pl','se','ie','za','mx'])[(user_id % 25 + 1)::INT] AS outlet,
    CAST(CAST(CAST(round((value * 1000 - 20000.0) * 100) AS BIGINT) * 1285737123 AS DECIMAL(20,0))
      * CAST('0.000000000000001' AS DECIMAL(16,15)) AS VARCHAR) || ',1.5,2.5,4.0,20.1,0.5,310' AS tone_text,
    CAST(CAST(CAST(CAST(round((value * 1000 - 20000.0) * 100) AS BIGINT) * 1285737123 AS DECIMAL(20,0))
      * CAST('0.000000000000001' AS DECIMAL(16,15)) AS VARCHAR) AS DOUBLE) AS tone
  FROM events)"""


def _daily(name: str, articles: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT date, iso AS country_iso3, avg(tone) AS avg_tone,
    (count(DISTINCT doc) + max(CASE WHEN doc IS NULL THEN 1 ELSE 0 END))::BIGINT AS article_count
  FROM {articles} WHERE iso IS NOT NULL GROUP BY date, iso)"""


def _cube(name: str, daily: str) -> str:
    return f"""{name}_spine AS (
  SELECT CAST(d AS DATE) AS date, country_iso3
  FROM (SELECT DISTINCT country_iso3 FROM {daily}),
       (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM {daily})),
{name} AS MATERIALIZED (
  SELECT date, country_iso3,
    last_value(avg_tone IGNORE NULLS) OVER (PARTITION BY country_iso3 ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS avg_tone,
    coalesce(article_count, 0) AS article_count
  FROM {name}_spine LEFT JOIN {daily} USING (date, country_iso3))"""


DAILY = ART + ",\n" + _daily("daily", "art")
CUBE = DAILY + ",\n" + _cube("cube", "daily")
DENSE_DAILY = EVENT_ART + ",\n" + _daily("dense_daily", "event_art")
DENSE = DENSE_DAILY + ",\n" + _cube("dense", "dense_daily")

WEIGHTED = "sum(avg_tone * article_count) / sum(article_count)"
COVERED = "avg_tone IS NOT NULL AND article_count > 0"
VOLUME = "sum(article_count)::BIGINT"

TIMELINE = CUBE + f""",
timeline AS MATERIALIZED (
  SELECT date, {WEIGHTED} AS avg_tone, {VOLUME} AS article_count
  FROM cube WHERE {COVERED} GROUP BY date)"""

ERA_LADDER = """CASE WHEN date < DATE '1996-07-01' THEN 0 WHEN date < DATE '1998-01-01' THEN 1
  WHEN date < DATE '1999-01-01' THEN 2 WHEN date < DATE '2000-01-01' THEN 3 ELSE 4 END"""

ERA_STATS = CUBE + f""",
era_stats AS MATERIALIZED (
  SELECT {ERA_LADDER} AS era, country_iso3, {WEIGHTED} AS avg_tone, {VOLUME} AS article_count
  FROM cube WHERE {COVERED} GROUP BY ALL),
era_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY era ORDER BY article_count DESC, country_iso3)::INT AS rank
  FROM era_stats)"""

COUNTRY = CUBE + f""",
country AS MATERIALIZED (
  SELECT country_iso3, {WEIGHTED} AS avg_tone, {VOLUME} AS article_count
  FROM cube WHERE {COVERED} GROUP BY country_iso3)"""


def _title_sql(text: str) -> str:
    """Capitalize each blank-separated word."""
    return (
        f"array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split({text}, ' ')], ' ')"
    )


# One row per kept mention. Which themes survive follows from the part's size and name.
MENTION_ROWS = ART + f""",
mention_rows AS MATERIALIZED (
  SELECT 'orgs' AS signal, iso AS country_iso3, era, doc, name, lower(name) AS key FROM (
    SELECT iso, era, doc, CASE WHEN linenumber % 2 = 1 THEN upper(p_brand) ELSE p_brand END AS name
    FROM art WHERE p_brand <> 'Brand#7'
    UNION ALL SELECT iso, era, doc, s_name FROM art)
  UNION ALL
  SELECT 'themes', iso, era, doc, {_title_sql('label')}, label FROM (
    SELECT iso, era, doc, p_name AS label FROM art WHERE linenumber <> 6
    UNION ALL SELECT iso, era, doc, word1 FROM art WHERE linenumber <> 6 AND p_size % 5 <> 0
    UNION ALL SELECT iso, era, doc, kind FROM art WHERE linenumber <> 6 AND p_size <= 40))"""

MENTIONS = MENTION_ROWS + """,
mentions AS MATERIALIZED (
  SELECT signal, country_iso3, era, key, min(name) AS name, count(*) AS count
  FROM mention_rows GROUP BY signal, country_iso3, era, key)"""

ROLLUP = MENTIONS + """,
rollup_rows AS MATERIALIZED (
  SELECT 'global' AS scope, NULL::VARCHAR AS country_iso3, 'all' AS bucket, signal, key,
    sum(count)::BIGINT AS count, min(name) AS name FROM mentions GROUP BY signal, key
  UNION ALL
  SELECT 'global', NULL, era::VARCHAR, signal, key, sum(count)::BIGINT, min(name)
  FROM mentions GROUP BY era, signal, key
  UNION ALL
  SELECT 'country', country_iso3, 'all', signal, key, sum(count)::BIGINT, min(name)
  FROM mentions WHERE country_iso3 IS NOT NULL GROUP BY country_iso3, signal, key
  UNION ALL
  SELECT 'country', country_iso3, era::VARCHAR, signal, key, sum(count)::BIGINT, min(name)
  FROM mentions WHERE country_iso3 IS NOT NULL GROUP BY country_iso3, era, signal, key),
top_rows AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY scope, country_iso3, bucket, signal
      ORDER BY count DESC, key)::INT AS rank FROM rollup_rows) WHERE rank <= 30)"""


def _kept(threshold: int) -> str:
    return f"""kept AS (
  SELECT country_iso3, sum(count)::BIGINT AS mentions FROM mentions
  WHERE signal = 'orgs' AND country_iso3 IS NOT NULL GROUP BY country_iso3
  HAVING sum(count) >= {threshold})"""


def _ranked(threshold: int) -> str:
    return ROLLUP + ",\n" + _kept(threshold) + """,
ranked AS MATERIALIZED (
  SELECT * FROM top_rows
  WHERE scope = 'global' OR country_iso3 IN (SELECT country_iso3 FROM kept))"""


RANKED = _ranked(50)
TOPIC_COLUMNS = "SELECT scope, country_iso3, bucket, signal, key, name, count, rank FROM ranked"


def _distinct_ranked(threshold: int) -> str:
    """Distinct articles, counted anew from the mentions at every grain."""
    grains = [
        ("'global'", "NULL::VARCHAR", "'all'"), ("'global'", "NULL", "era::VARCHAR"),
        ("'country'", "country_iso3", "'all'"), ("'country'", "country_iso3", "era::VARCHAR"),
    ]
    union = " UNION ALL ".join(
        f"""SELECT scope, country, bucket, signal, key, count(DISTINCT doc) AS count, min(name) AS name
FROM (SELECT {scope} AS scope, {country} AS country, {bucket} AS bucket, signal, key, doc, name FROM mention_rows
  WHERE {scope} = 'global' OR country_iso3 IS NOT NULL) GROUP BY ALL"""
        for scope, country, bucket in grains
    )
    return MENTION_ROWS + f""",
kept AS (SELECT country_iso3 FROM mention_rows WHERE signal = 'orgs' AND country_iso3 IS NOT NULL
  GROUP BY country_iso3 HAVING count(DISTINCT doc) >= {threshold}),
counted AS (SELECT scope, country AS country_iso3, bucket, signal, key, count, name FROM ({union}) WHERE count > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY scope, country_iso3, bucket, signal ORDER BY count DESC, key)::INT AS rank
  FROM counted WHERE scope = 'global' OR country_iso3 IN (SELECT country_iso3 FROM kept) QUALIFY rank <= 30)"""

# Text size: halves round up.
_SIZE = "floor(10 + sqrt(count / max(count) OVER ({part})) * 22 * {weight} + 0.5)::BIGINT"

BLEND = RANKED + """,
sized AS (
  SELECT scope, country_iso3, bucket, name AS text, rank, 0 AS list,
    """ + _SIZE.format(part="PARTITION BY scope, country_iso3, bucket", weight="1.0") + """ AS size
  FROM ranked WHERE signal = 'themes' AND rank <= 18
  UNION ALL
  SELECT scope, country_iso3, bucket, name, rank, 1,
    """ + _SIZE.format(part="PARTITION BY scope, country_iso3, bucket", weight="0.9") + """
  FROM ranked WHERE signal = 'orgs' AND rank <= 8),
unique_words AS (
  SELECT * FROM sized QUALIFY row_number() OVER (
    PARTITION BY scope, country_iso3, bucket, lower(text) ORDER BY list, rank) = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY scope, country_iso3, bucket
    ORDER BY size DESC, list, rank)::INT AS position FROM unique_words)"""

# The feed's input: keys present, tone as it is.
PARSED = ART + """,
parsed AS MATERIALIZED (
  SELECT doc AS DocumentIdentifier, source AS SourceCommonName, date, tone, iso, words
  FROM art WHERE doc IS NOT NULL),
unique_docs AS MATERIALIZED (
  SELECT * FROM parsed QUALIFY row_number() OVER (
    PARTITION BY DocumentIdentifier ORDER BY date, SourceCommonName NULLS FIRST, tone NULLS FIRST) = 1)"""

_POOL = """pool AS (
  SELECT * FROM unique_docs ORDER BY md5('7|' || DocumentIdentifier), DocumentIdentifier LIMIT {n})"""

# Positions floor(i * total / final) of an ordered list.
_PICKS = """picks AS (
  SELECT floor(i * greatest(1.0, total / {final}::DOUBLE))::BIGINT AS pick
  FROM (SELECT count(*) AS total FROM {rows}), (SELECT unnest(range({final})) AS i))"""

SCAN_WHERE = """p_type = 'PROMO' AND ((linenumber <> 7 AND p_partkey % 5 <> 0) OR p_size <= 40 OR s_suppkey % 2 = 0)"""
HOT_WHERE = """word1 = 'hot' AND (linenumber <> 7 OR p_size % 5 = 3)"""
MONTHS_WHERE = "date BETWEEN DATE '1996-02-01' AND DATE '1999-11-30'"

CENTRED = """SELECT {keys}date,
  round(coalesce(sum(avg_tone * article_count) OVER w / nullif(sum(article_count) OVER w, 0), 0), 8) AS avg_tone,
  floor(sum(article_count) OVER w / count(*) OVER w + 0.5)::BIGINT AS article_count
FROM {rows} WINDOW w AS ({part}ORDER BY date ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"""


def _smooth(rows, window, keys="", part=""):
    return CENTRED.format(
        rows=rows, keys=keys, part=part, before=window // 2, after=window - window // 2 - 1
    )


def _frames(rows: str, size: int, start: str, step: int = 1) -> str:
    return f"""SELECT date, country_iso3, round(mass / total, 8) AS avg_tone,
  floor(total / least({size}, date_diff('day', {start}, date) // {step} + 1) + 0.5)::BIGINT AS article_count
FROM (SELECT date, country_iso3, sum(avg_tone * article_count) OVER w AS mass,
    sum(article_count) FILTER (avg_tone IS NOT NULL) OVER w AS total
  FROM {rows} WHERE date >= {start} AND date_diff('day', {start}, date) % {step} = 0
  WINDOW w AS (PARTITION BY country_iso3 ORDER BY date ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW))
WHERE total > 0 AND mass IS NOT NULL"""


def _two_ends(rows, value, low, high, label, columns):
    return f"""SELECT {columns}, '{low}' AS {label},
  row_number() OVER (ORDER BY {value}, country_iso3)::INT AS rank FROM {rows}
QUALIFY rank <= 10
UNION ALL
SELECT {columns}, '{high}', row_number() OVER (ORDER BY {value} DESC, country_iso3)::INT AS rank FROM {rows}
QUALIFY rank <= 10"""


def _pos_neg(volume: int) -> str:
    return COUNTRY + f""",
toned AS (SELECT * FROM country WHERE article_count >= {volume})"""


POS_NEG = _pos_neg(100)

CUBE_COLUMNS = "date, country_iso3, round(avg_tone, 8) AS avg_tone, article_count"
TREND = """indexed AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i FROM {rows}),
fit AS (SELECT coalesce(regr_slope(avg_tone, i), 0) AS slope,
  coalesce(regr_intercept(avg_tone, i), avg(avg_tone)) AS intercept FROM indexed)"""
DOWNSAMPLE = """SELECT * EXCLUDE (pos, n) FROM (
  SELECT *, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM {rows})
  WHERE pos % greatest(1, n // 500) = 0"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _extremes(rows: str, tie: str) -> str:
    return f"""SELECT era,
  first(country_iso3 ORDER BY avg_tone, {tie}) AS most_negative, round(min(avg_tone), 8) AS negative_tone,
  first(country_iso3 ORDER BY avg_tone DESC, {tie}) AS most_positive, round(max(avg_tone), 8) AS positive_tone
FROM {rows} GROUP BY era"""


def _feed_rows(pool: int, final: int) -> str:
    title = _title_sql("words")
    return (
        PARSED + ",\n" + _POOL.format(n=pool) + f""",
titled AS (SELECT *, {title} AS title FROM pool WHERE words IS NOT NULL AND length(words) BETWEEN 14 AND 90),
numbered AS (SELECT *, row_number() OVER (ORDER BY date, DocumentIdentifier) - 1 AS pos FROM titled),
""" + _PICKS.format(final=final, rows="titled") + """,
feed AS (
  SELECT title, lower(coalesce(SourceCommonName, '')) AS source, iso,
    strftime(date, '%Y-%m-%d') AS date, CASE WHEN round_even(tone, 2) = 0 THEN 0 ELSE round_even(tone, 2) END AS tone
  FROM numbered WHERE pos IN (SELECT pick FROM picks))"""
    )


CSV_FIELDS = """packed AS "DATE", tone_text || ',1.5,2.5,4.0,20.1,0.5,310' AS V2Tone,
  '1#Nation#N' || nation || '#X#48#2#FR;4#City, Place#N' || (p_size % 25) || '#X1#1#2#-99' AS V2Locations,
  source AS SourceCommonName, doc AS DocumentIdentifier,
  CASE WHEN linenumber <> 6 THEN 'ECON_' || upper(replace(p_name, ' ', '_')) || ',' || (linenumber * 10) || ';'
    || ['TAX_','ENV_','POLITICAL_','','SECURITY_'][p_size % 5 + 1] || upper(word1) || ',9;'
    || p_type || CASE WHEN p_size > 40 THEN '_' || p_size ELSE '' END || ',77;MEDICAL,20;' END AS V2Themes"""

_NAMES = """names AS (
  SELECT (['FRA','DEU','GBR','USA',NULL,NULL,'TUV','ITA','ESP','JPN','CHN','IND','BRA','CAN','AUS',
    NULL,'TUR','KOR','UKR','RUS','POL','SWE','IRL','ZAF','MEX'])[n_nationkey + 1] AS iso3, n_name AS name
  FROM nation WHERE n_nationkey <> 7)"""

_ERA_START = [
    "DATE '1995-01-01'", "DATE '1996-07-01'", "DATE '1998-01-01'", "DATE '1999-01-01'", "DATE '2000-01-01'",
]


def statements() -> dict[str, str]:
    sql = {}

    # Sources and sinks
    sql["topic_scan"] = _with(ART, f"""SELECT packed AS "DATE", source AS SourceCommonName, doc AS DocumentIdentifier
FROM art WHERE {MONTHS_WHERE} AND {SCAN_WHERE} AND {HOT_WHERE}""")
    sql["csv_extract"] = _with(ART, f"SELECT {CSV_FIELDS} FROM art")
    sql["materialize_scan"] = _with(ART, f"""SELECT "DATE", V2Tone, V2Themes FROM (
  SELECT {CSV_FIELDS} FROM art WHERE {MONTHS_WHERE} AND {SCAN_WHERE} AND {HOT_WHERE})""")
    clicks = EVENT_ART + ",\nclicks AS (SELECT * FROM event_art WHERE doc LIKE '%click%')"
    sql["incremental_scan"] = _with(clicks, """SELECT CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS "DATE",
  outlet AS SourceCommonName, 'https://wire.example/' || doc AS DocumentIdentifier, tone_text AS V2Tone FROM clicks""")
    sql["incremental_coverage"] = _with(
        clicks + ",\n" + _daily("daily", "clicks") + ",\n" + _cube("cube", "daily"), f"SELECT {CUBE_COLUMNS} FROM cube")
    profile = """SELECT min(date) AS first_date, max(date) AS last_date,
  count(DISTINCT country_iso3) AS countries, count(*) AS total_rows,
  sum(article_count)::BIGINT AS total_articles FROM {rows}"""
    sql["read_coverage"] = _with(CUBE, profile.format(rows="cube"))
    sql["write_coverage"] = _with(CUBE, f"SELECT {CUBE_COLUMNS} FROM cube")
    sql["write_topics"] = _with(RANKED, TOPIC_COLUMNS)
    sql["write_articles"] = _with(_feed_rows(80000, 320), "SELECT * FROM feed")
    sql["read_json_artifact"] = _with(TIMELINE, "SELECT date, round(avg_tone, 8) AS avg_tone, article_count FROM timeline")
    sql["country_names"] = _with(_NAMES, "SELECT iso3, max(name) AS name FROM names WHERE iso3 IS NOT NULL GROUP BY iso3")

    # Filters
    url = "linenumber <> 7"
    matches = {
        "promo": SCAN_WHERE, "hot promo": f"({SCAN_WHERE}) AND ({HOT_WHERE})", "hot": HOT_WHERE,
        "rod": f"p_name LIKE '% rod' AND {url}", "old rod": f"p_name IN ('old rod', 'cold rod') AND p_partkey % 5 <> 2 AND {url}",
    }
    sql["topic_match"] = _with(ART, " UNION ALL ".join(
        f"""SELECT '{name}' AS topic, packed AS "DATE", source AS SourceCommonName, doc AS DocumentIdentifier
FROM art WHERE {MONTHS_WHERE} AND {where}""" for name, where in matches.items()))
    sql["keyword_match"] = _with(ART, f"""SELECT packed AS "DATE", source AS SourceCommonName,
  'ECON_' || upper(replace(p_name, ' ', '_')) || ';' || ['TAX_','ENV_','POLITICAL_','','SECURITY_'][p_size % 5 + 1]
    || upper(word1) || ';' || p_type || CASE WHEN p_size > 40 THEN '_' || p_size ELSE '' END AS Themes,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Promo Carter,12' ELSE 'Ann Lee,7' END AS V2Persons
FROM art WHERE {SCAN_WHERE}""")
    sql["partition_range"] = _with(ART, f"""SELECT packed AS "DATE", date AS partition_date, source AS SourceCommonName
FROM art WHERE {MONTHS_WHERE}""")
    sql["parse_packed_date"] = _with(ART, """SELECT packed AS "DATE", date, strftime(date, '%Y-%m-%d') AS date_text FROM art""")
    sql["first_tone"] = _with(ART, 'SELECT packed AS "DATE", tone FROM art')
    sql["valid_country"] = _with(ART, "SELECT iso AS country_iso3, count(*) AS records FROM art WHERE iso IS NOT NULL GROUP BY iso")
    sql["era_of"] = _with(ART, "SELECT era, count(*) AS records FROM art GROUP BY era")
    sql["covered_only"] = _with(CUBE, f"SELECT {CUBE_COLUMNS} FROM cube WHERE {COVERED}")
    sql["drop_null_keys"] = _with(PARSED, "SELECT DocumentIdentifier, SourceCommonName, date, round(tone, 8) AS tone FROM parsed")
    sql["era_slice"] = _with(TIMELINE, """SELECT date, round(avg_tone, 8) AS avg_tone, article_count
FROM timeline WHERE date >= DATE '1998-01-01' AND date < DATE '1999-01-01'""")
    sql["optional_columns"] = _with(MENTION_ROWS, """SELECT 'themes' AS signal, count(*) AS records FROM mention_rows WHERE signal = 'themes'
UNION ALL SELECT 'articles', count(*) FROM lineitem UNION ALL SELECT 'orgs', 0""")

    # Joins
    sql["outlet_country"] = _with(ART, """SELECT source AS SourceCommonName, iso AS country_iso3, count(*) AS records
FROM art GROUP BY source, iso""")
    sql["date_country_spine"] = _with(CUBE, "SELECT date, country_iso3 FROM cube_spine")
    sql["gap_join"] = _with(CUBE, f"SELECT {CUBE_COLUMNS} FROM cube_spine LEFT JOIN daily USING (date, country_iso3)")
    frequencies = "SELECT key, min(name) AS name, sum(count)::BIGINT AS count FROM mentions WHERE signal = 'themes' GROUP BY key"
    sql["stop_anti_join"] = _with(MENTIONS, f"SELECT * FROM ({frequencies}) WHERE key NOT IN ('hot', 'old rod', 'economy')")
    sql["kept_country_semi_join"] = _with(MENTIONS + ",\n" + _kept(4800), """SELECT country_iso3, signal, era, key, count
FROM mentions WHERE country_iso3 IN (SELECT country_iso3 FROM kept)""")
    sql["country_label_join"] = _with(COUNTRY + ",\n" + _NAMES, """SELECT country_iso3, article_count, coalesce(name, country_iso3) AS country_name
FROM country LEFT JOIN names ON country_iso3 = iso3""")
    sql["map_frame_join"] = _with(CUBE + ",\n" + _NAMES + f""",
frame AS (SELECT * FROM cube WHERE date = DATE '1998-03-14' AND {COVERED}),
joined AS (
  SELECT iso3, name, avg_tone, coalesce(article_count, 0) AS article_count,
    least(10, abs(avg_tone)) AS mag, (SELECT greatest(1, max(article_count)) FROM frame) AS largest
  FROM names LEFT JOIN frame ON iso3 = country_iso3 WHERE iso3 IS NOT NULL)""",
        """SELECT iso3, name, round(avg_tone, 8) AS avg_tone, article_count,
  round(CASE WHEN avg_tone IS NOT NULL AND article_count <> 0
    THEN 0.75 * pow(least(1, mag), 0.7) + 0.25 * least(1, greatest(0, (mag - 1) / 4)) ELSE 0 END, 8)::DOUBLE AS tone_intensity,
  round(article_count / largest, 8) AS volume_ratio FROM joined""")
    sql["narrative_affinity"] = _with(RANKED + """,
dominant AS (
  SELECT country_iso3, key, count(*) OVER (PARTITION BY country_iso3) AS n FROM ranked
  WHERE scope = 'country' AND bucket = 'all' AND signal = 'themes' AND rank <= 20)""",
        """SELECT a.country_iso3 AS country_a, b.country_iso3 AS country_b, count(*) AS shared,
  round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 8) AS affinity
FROM dominant a JOIN dominant b ON a.key = b.key AND a.country_iso3 < b.country_iso3 GROUP BY ALL HAVING count(*) >= 15""")
    picked = """SELECT DocumentIdentifier, SourceCommonName, date, round(tone, 8) AS tone FROM numbered
WHERE pos IN (SELECT pick FROM picks)"""
    sql["even_pick_join"] = _with(
        PARSED + """,
numbered AS (SELECT *, row_number() OVER (ORDER BY date, DocumentIdentifier) - 1 AS pos FROM unique_docs),
""" + _PICKS.format(final=100, rows="unique_docs"), picked)

    # Aggregations
    sql["daily_country_sentiment"] = _with(DAILY + ",\n" + DENSE_DAILY,
        f"SELECT {CUBE_COLUMNS} FROM daily UNION ALL SELECT {CUBE_COLUMNS} FROM dense_daily")
    sql["mention_counts"] = _with(MENTIONS, "SELECT signal, country_iso3, era, key, name, count FROM mentions")
    sql["distinct_article_mentions"] = _with(MENTION_ROWS, """SELECT signal, country_iso3, era, key, count(DISTINCT doc) AS count
FROM mention_rows GROUP BY ALL""")
    sql["topic_rollup"] = _with(ROLLUP, "SELECT * FROM rollup_rows")
    sql["kept_countries"] = _with(MENTIONS + ",\n" + _kept(4800), "SELECT * FROM kept")
    sql["era_countries_grouped"] = _with(ERA_STATS, "SELECT era, country_iso3, round(avg_tone, 8) AS avg_tone, article_count FROM era_stats")
    sql["frame_average"] = _with(DENSE, f"""SELECT date, round(sum(avg_tone * article_count) FILTER ({COVERED})
  / sum(article_count) FILTER ({COVERED}), 8) AS avg_tone FROM dense GROUP BY date""")
    sql["country_share"] = _with(CUBE + f""",
totals AS (
  SELECT country_iso3, {VOLUME} AS total_articles,
    sum(avg_tone * article_count) / sum(article_count) AS mean_tone
  FROM cube WHERE article_count > 0 GROUP BY country_iso3),
shown AS (SELECT * FROM totals ORDER BY total_articles DESC, country_iso3 LIMIT 12)""",
        """SELECT country_iso3, total_articles, round(mean_tone, 8) AS mean_tone,
  round(100.0::DOUBLE * total_articles / (SELECT sum(total_articles) FROM shown), 8) AS pct,
  round(100.0::DOUBLE * total_articles / (SELECT sum(total_articles) FROM totals), 8) AS pct_of_all FROM shown""")
    sql["cube_profile"] = _with(CUBE, profile.format(rows="cube"))
    sql["headline"] = _with(CUBE, f"""SELECT {VOLUME} AS total_articles, count(DISTINCT country_iso3) AS countries,
  round({WEIGHTED}, 8) AS avg_tone, min(date) || ' to ' || max(date) AS date_range FROM cube WHERE {COVERED}""")
    early, late = "date < DATE '1998-01-01'", "date >= DATE '1999-01-01'"
    moved = ",\n".join(
        f"sum(avg_tone * article_count) FILTER ({p} AND {COVERED}) / sum(article_count) FILTER ({p} AND {COVERED}) AS {n}, "
        f"sum(article_count) FILTER ({p} AND {COVERED}) AS n_{n}"
        for n, p in (("early", early), ("late", late))
    )
    sql["opinion_changers"] = _with(CUBE + f""",
moved AS (SELECT *, late - early AS delta FROM (SELECT country_iso3, {moved} FROM cube GROUP BY country_iso3)
  WHERE n_early >= 100 AND n_late >= 100)""",
        _two_ends("moved", "delta", "worsened", "improved", "direction",
                  "country_iso3, round(early, 8) AS early, round(late, 8) AS late, round(delta, 8) AS delta"))
    ends = _two_ends("toned", "avg_tone", "most_negative", "most_positive", "side",
                     "country_iso3, round(avg_tone, 8) AS avg_tone, article_count").replace("ORDER BY avg_tone", "ORDER BY toned.avg_tone")
    sql["pos_neg_countries"] = _with(_pos_neg(618), ends)
    sql["era_extremes_published"] = _with(ERA_STATS + """,
loud AS (SELECT * FROM era_stats WHERE article_count >= 100)""", _extremes("loud", "country_iso3"))
    sql["era_extremes_topvol"] = _with(ERA_STATS + """,
loud AS (SELECT * FROM era_ranked WHERE rank <= 15)""", _extremes("loud", "rank"))
    sql["topic_volume_rank"] = _with(RANKED, """SELECT country_iso3, sum(count)::BIGINT AS mentions FROM ranked
WHERE scope = 'country' AND bucket = 'all' AND signal = 'orgs' GROUP BY country_iso3
ORDER BY mentions DESC, country_iso3 LIMIT 6""")
    trend = """SELECT date, round(avg_tone, 8) AS avg_tone, article_count, i, round(slope, 8) AS slope,
  round(intercept, 8) AS intercept, round(intercept + slope * i, 8) AS trend"""
    sql["tone_trend"] = _with(TIMELINE + ",\n" + TREND.format(rows="timeline"), trend + " FROM indexed, fit")
    sql["distinct_outlets"] = _with(ART, "SELECT DISTINCT source AS SourceCommonName FROM art WHERE source IS NOT NULL")
    sql["tone_distribution"] = _with(ART, """SELECT bin, count(*) AS records, round(-5.0::DOUBLE + (bin - 1) * 0.4::DOUBLE, 8) AS bin_low FROM (
  SELECT CASE WHEN tone < -5 THEN 0 WHEN tone >= 5 THEN 26 ELSE floor((tone + 5) / 10 * 25)::BIGINT + 1 END AS bin
  FROM art WHERE tone IS NOT NULL AND iso IS NOT NULL) GROUP BY bin""")
    sql["tone_distribution_by_country"] = _with(ART, """SELECT country_iso3, bin, count(*) AS records,
  round(-5.0::DOUBLE + (bin - 1) * 0.4::DOUBLE, 8) AS bin_low FROM (
  SELECT iso AS country_iso3, CASE WHEN tone < -5 THEN 0 WHEN tone >= 5 THEN 26 ELSE floor((tone + 5) / 10 * 25)::BIGINT + 1 END AS bin
  FROM art WHERE tone IS NOT NULL AND iso IS NOT NULL AND year(date) = 1997) GROUP BY ALL""")
    sql["article_volume"] = _with(ART, "SELECT date, count(*) AS records, count(DISTINCT doc) AS articles FROM art WHERE iso IS NOT NULL GROUP BY date")
    sql["country_volume"] = _with(ART, """SELECT iso AS country_iso3, count(*) AS records, count(DISTINCT doc) AS articles
FROM art WHERE iso IS NOT NULL GROUP BY iso""")
    sql["axis_stats"] = _with(TIMELINE, """SELECT round(low, 8) AS low, round(high, 8) AS high,
  round(high / CASE WHEN high = low THEN 1 ELSE high - low END, 8) AS zero_offset
FROM (SELECT least(min(avg_tone), 0) AS low, greatest(max(avg_tone), 0) AS high FROM timeline)""")
    sql["theme_keyword_counts"] = _with(MENTIONS, frequencies)
    sql["coverage_spread"] = _with(CUBE, f"""SELECT date, new_countries,
  (sum(new_countries) OVER (ORDER BY date))::BIGINT AS countries_reached
FROM (SELECT date, count(*) AS new_countries FROM (
  SELECT country_iso3, min(date) AS date FROM cube WHERE {COVERED} GROUP BY country_iso3) GROUP BY date)""")
    sql["location_counts"] = _with(ART, """SELECT country, count(*) AS mentions, count(DISTINCT doc) AS articles FROM (
  SELECT 'N' || nation AS country, doc FROM art UNION ALL SELECT 'N' || (p_size % 25), doc FROM art) GROUP BY country""")

    # Windows
    sql["forward_fill"] = _with(CUBE, f"SELECT {CUBE_COLUMNS} FROM cube")
    sql["rolling_country_frame"] = _with(CUBE, _frames("cube", 45, "(SELECT min(date) FROM cube)"))
    sql["rolling_country_frame_fast"] = _with(
        CUBE, _frames("cube", 300, "DATE '1998-05-01'", 3))
    sql["smooth_timeline"] = _with(TIMELINE, _smooth("timeline", 90))
    sql["smooth_country_timelines"] = _with(
        DENSE, _smooth("(SELECT * FROM dense WHERE avg_tone IS NOT NULL)", 7, "country_iso3, ", "PARTITION BY country_iso3 "))
    sql["top_n_per_group"] = _with(ROLLUP, "SELECT * FROM top_rows")
    sql["downsample"] = _with(TIMELINE, f"SELECT date, round(avg_tone, 8) AS avg_tone, article_count FROM ({DOWNSAMPLE.format(rows='timeline')})")
    sql["rolling_30d"] = _with(DAILY, """SELECT date, country_iso3, round(avg_tone, 8) AS avg_tone, article_count,
  round(avg(avg_tone) OVER (PARTITION BY country_iso3 ORDER BY date
    RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW), 8) AS rolling_tone
FROM daily""")
    starts = " UNION ALL ".join(f"SELECT {e} AS era, {d} AS boundary" for e, d in enumerate(_ERA_START))
    sql["era_spans"] = _with(CUBE + f""",
dates AS (SELECT DISTINCT date FROM cube),
starts AS (
  SELECT era, (SELECT CASE WHEN max(date) >= boundary THEN count(*) FILTER (date < boundary) ELSE 0 END FROM dates) AS start_index,
    (SELECT count(*) FROM dates) AS total FROM ({starts}))""",
        """SELECT era, start_index, round(start_index / total, 8) AS start_share,
  round((coalesce(lead(start_index) OVER (ORDER BY era), total) - start_index) / total, 8) AS width_share FROM starts""")
    sql["sparkline_points"] = _with(TIMELINE + f""",
smoothed AS ({_smooth('timeline', 30).replace('round(coalesce(', '(coalesce(').replace(', 0), 0), 8)', ', 0), 0))')}),
in_era AS (
  SELECT {ERA_LADDER} AS era, date, avg_tone FROM smoothed
  WHERE date >= DATE '1995-01-01' AND date < DATE '2002-01-01'),
scaled AS (
  SELECT *, row_number() OVER (PARTITION BY era ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY era) AS n,
    greatest(max(avg_tone) OVER (PARTITION BY era), 0.5) AS high, least(min(avg_tone) OVER (PARTITION BY era), -0.5) AS low
  FROM in_era)""",
        "SELECT era, date, round(i / (n - 1), 8) AS x, round((high - avg_tone) / (high - low), 8) AS y FROM scaled WHERE n >= 2")
    sql["first_match"] = _with(ART, """SELECT date, round(tone, 8) AS tone, source AS SourceCommonName, doc AS DocumentIdentifier, iso AS country_iso3
FROM art WHERE iso IS NOT NULL AND doc IS NOT NULL AND tone IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY date, iso ORDER BY doc, source NULLS FIRST, tone) = 1""")

    sql["url_title"] = r"""WITH sentences AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS sentence FROM documents),
words AS (
  SELECT doc_id, [w FOR w IN regexp_extract_all(sentence, '[\p{L}\p{N}]+') IF
    CASE WHEN regexp_full_match(w, '[0-9]+') THEN length(w) <= 4
      ELSE NOT regexp_full_match(w, '[0-9a-fA-F]{8,}') AND regexp_matches(w, '[A-Za-zÀ-ÿ]') END] AS words
  FROM sentences),
readable AS (
  SELECT doc_id, array_to_string(words, ' ') AS line FROM words
  WHERE len([w FOR w IN words IF regexp_matches(w, '[A-Za-zÀ-ÿ]')]) >= 4),
titled AS (
  SELECT doc_id, array_to_string([CASE WHEN r[1] = 'ß' THEN 'Ss' ELSE upper(r[1]) END || r[2:]
    FOR r IN regexp_extract_all(lower(line), '\p{L}+|[^\p{L}]+')], '') AS title
  FROM readable WHERE length(line) BETWEEN 14 AND 90)
SELECT title, count(*) AS records, count(DISTINCT doc_id) AS documents FROM titled GROUP BY title"""

    # Sorts, limits, sets, samples
    sql["sorted_outputs"] = _with(DAILY, f"SELECT {CUBE_COLUMNS} FROM daily ORDER BY date, country_iso3")
    sql["top_k"] = _with(CUBE, f"SELECT {CUBE_COLUMNS} FROM cube ORDER BY article_count DESC, date, country_iso3 LIMIT 60")
    sql["top8_by_tone"] = _with(ERA_STATS, """SELECT era, country_iso3, round(avg_tone, 8) AS avg_tone, article_count, rank,
  row_number() OVER (PARTITION BY era ORDER BY era_ranked.avg_tone, rank)::INT AS position FROM era_ranked WHERE rank <= 8""")
    sql["word_blend"] = _with(BLEND, "SELECT scope, country_iso3, bucket, position, text, size FROM placed WHERE position <= 26")
    sql["dedupe_articles"] = _with(PARSED, "SELECT DocumentIdentifier, SourceCommonName, date, round(tone, 8) AS tone FROM unique_docs")
    sql["union_scale"] = _with(POS_NEG, """SELECT round(greatest(0.5, max(abs(avg_tone))), 8) AS scale FROM (
  (SELECT avg_tone FROM toned ORDER BY avg_tone LIMIT 10) UNION ALL (SELECT avg_tone FROM toned ORDER BY avg_tone DESC LIMIT 10))""")
    sql["pool_sample"] = _with(PARSED + ",\n" + _POOL.format(n=400),
        "SELECT DocumentIdentifier, SourceCommonName, date, round(tone, 8) AS tone FROM pool")
    sql["even_sample"] = _with(PARSED + """,
numbered AS (SELECT *, row_number() OVER (ORDER BY date, md5('7|' || DocumentIdentifier)) - 1 AS pos FROM unique_docs),
""" + _PICKS.format(final=150, rows="unique_docs"), picked)
    sql["random_extract"] = _with(ART + f""",
extract AS (SELECT {CSV_FIELDS} FROM art)""", """SELECT * FROM extract
ORDER BY md5('7|' || "DATE" || '|' || coalesce(V2Tone, '') || '|' || V2Locations || '|' || coalesce(SourceCommonName, '')
  || '|' || coalesce(DocumentIdentifier, '') || '|' || coalesce(V2Themes, ''))
LIMIT 10000""")
    sql["ranked_words"] = _with(RANKED, "SELECT scope, country_iso3, bucket, signal, rank AS position, name AS text, "
        + _SIZE.format(part="PARTITION BY scope, country_iso3, bucket, signal", weight="1.0") + " AS size FROM ranked WHERE rank <= 18")

    # Served queries
    sql["available_dates"] = _with(CUBE, "SELECT DISTINCT date FROM cube ORDER BY date")
    sql["sentiment_by_date"] = _with(CUBE, "SELECT country_iso3, round(avg_tone, 8) AS avg_tone, article_count FROM cube WHERE date = DATE '1998-03-14'")
    sql["era_countries"] = sql["era_countries_grouped"]
    sql["country_timeline"] = _with(CUBE, """SELECT date, round(avg_tone, 8) AS avg_tone, article_count FROM cube
WHERE country_iso3 = 'GBR' AND avg_tone IS NOT NULL ORDER BY date""")
    sql["global_timeline"] = sql["read_json_artifact"] + " ORDER BY date"
    sql["topic_words"] = _with(BLEND, """SELECT position, text, size FROM placed
WHERE scope = 'country' AND country_iso3 = 'USA' AND bucket = '1' AND position <= 11""")

    # Composite jobs
    sql["build_coverage"] = sql["forward_fill"]
    sql["build_topics"] = _with(_ranked(4800), TOPIC_COLUMNS)
    sql["build_topics_candidates"] = sql["build_topics"]
    sql["build_topics_distinct"] = _with(_distinct_ranked(500), TOPIC_COLUMNS)
    sql["build_feed"] = _with(_feed_rows(700, 320), "SELECT * FROM feed")
    smoothed = _smooth("timeline", 90).replace("round(coalesce(", "(coalesce(").replace(", 0), 0), 8)", ", 0), 0))")
    sql["overview_series"] = _with(
        TIMELINE + f",\nsmoothed AS ({smoothed}),\nchart AS ({DOWNSAMPLE.format(rows='smoothed')}),\n" + TREND.format(rows="chart") + """,
axis AS (SELECT least(min(avg_tone), 0) AS low, greatest(max(avg_tone), 0) AS high FROM chart)""",
        trend + ", round(high / CASE WHEN high = low THEN 1 ELSE high - low END, 8) AS zero_offset FROM indexed, fit, axis")

    changers = sql["opinion_changers"].replace("round(delta, 8) AS delta", "round(delta, 2) AS tone")
    places = _with(POS_NEG, ends).replace("round(avg_tone, 8) AS avg_tone", "round(avg_tone, 2) AS tone")
    extremes = sql["era_extremes_published"].replace(", 8)", ", 2)")
    total = sql["headline"].replace(", 8)", ", 2)")
    # Rounding gives negative zero here and plain zero in Spark.
    sql["write_summary"] = f"""SELECT part, iso, CASE WHEN tone = 0 THEN 0 ELSE tone END AS tone FROM (
SELECT direction AS part, country_iso3 AS iso, tone FROM ({changers})
UNION ALL SELECT side, country_iso3, tone FROM ({places})
UNION ALL SELECT 'most_negative ' || (row_number() OVER (ORDER BY era) - 1), most_negative, negative_tone FROM ({extremes})
UNION ALL SELECT 'most_positive ' || (row_number() OVER (ORDER BY era) - 1), most_positive, positive_tone FROM ({extremes})
UNION ALL SELECT 'headline', date_range, avg_tone FROM ({total}))"""

    sql["theme_label"] = _with(ART, f"""SELECT {_title_sql('label')} AS label, count(*) AS records FROM (
  SELECT p_name AS label FROM art
  UNION ALL SELECT CASE WHEN p_size % 5 <> 0 THEN word1 END FROM art
  UNION ALL SELECT CASE WHEN p_size <= 40 THEN kind END FROM art) GROUP BY label""")
    sql["slugify"] = """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand || '--' || p_type || ' Émile!'),
  '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part"""
    for name in ("pool_sample", "even_sample", "build_feed"):
        sql[f"{name}_stored"] = sql[name]

    # Streaming: the batch over all days
    sql["incremental_daily_sentiment"] = _with(DENSE_DAILY, f"SELECT {CUBE_COLUMNS} FROM dense_daily")
    return sql
