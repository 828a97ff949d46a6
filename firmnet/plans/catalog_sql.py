"""SQL on the driver's tables giving the results the catalog's queries must give."""

from __future__ import annotations

METRICS = ("profit_assets", "profit_sales", "stock_return", "valuation")

# --- input tables, as common table expressions ------------------------------------------------------

VECTORS = """vectors AS (
  SELECT CAST(vec_id AS VARCHAR) AS company, vec_id AS firm_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""

FIRM = """firm AS (
  SELECT company, firm_id,
         CASE WHEN firm_id % 17 = 0 THEN NULL WHEN firm_id % 13 = 0 THEN substr(code, 1, 4) ELSE code END AS naics
  FROM (SELECT CAST(vec_id AS VARCHAR) AS company, vec_id AS firm_id,
               concat(label + 10, vec_id % 5, vec_id % 3, vec_id % 2, '0') AS code FROM embeddings))"""

PUBLIC = """metrics AS (
  SELECT c_custkey AS firm_id, round(c_acctbal * 100) AS profit_assets, CAST(coalesce(n, 0) AS DOUBLE) AS profit_sales,
         CAST(coalesce(cents % 100003, 0) AS DOUBLE) AS stock_return, round(coalesce(top, 0.0) * 100) AS valuation
  FROM customer LEFT JOIN (
    SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
           max(o_totalprice) AS top FROM orders GROUP BY 1) ON c_custkey = o_custkey),
public AS (SELECT CAST(vec_id AS VARCHAR) AS company, firm_id, 'g' || vec_id AS gvkey, 2016 AS year,
                  profit_assets, profit_sales, stock_return, valuation
           FROM metrics JOIN embeddings ON vec_id = firm_id)"""

LISTED = "listed AS (SELECT company, firm_id + 10000000 AS firm_id FROM public WHERE firm_id % 3 <> 0)"

SCORES = """scores AS (
  SELECT a.firm_id AS focal_firmid, b.firm_id AS rival_firmid,
         round(list_cosine_similarity(a.v, b.v), 6) AS wtnic_score
  FROM vectors a JOIN vectors b ON a.firm_id <> b.firm_id)"""
PEERS = "peers AS (SELECT * FROM scores WHERE wtnic_score >= 0.24)"

URL_ID = """url_id AS (
  SELECT o_orderkey AS line_no, o_custkey + 1000000 * (o_orderkey % 2) AS master_id, c_name AS company,
         CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE year(o_orderdate) END AS year
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
CUSTOMER_FIRM = """cfirm AS (
  SELECT c_name AS company, c_custkey * 3 + 1 AS firm_id FROM customer WHERE c_acctbal > 0)"""

WORDS = "regexp_extract_all({}, '[a-zA-Z]{{3,}}')"
CORPUS = f"""corpus AS (
  SELECT source AS company, CAST(2010 + doc_id % 8 AS INTEGER) AS year, CAST(doc_id % 5 AS INTEGER) AS level,
         lpad(CAST(doc_id AS VARCHAR), 12, '0') AS page, {WORDS.format('text')} AS words FROM documents)"""
DOC_CORPUS = f"{CORPUS}, doc_corpus AS (SELECT * REPLACE (page AS company) FROM corpus)"
FIRM_PAGES = """firm_pages AS (
  SELECT company, year, level, page, list_transform(words, lambda w: lower(w)) AS words
  FROM {} WHERE year BETWEEN 2012 AND 2016 AND level <= 3)"""

RECORDS = """records AS (
  SELECT 'crawl-' || page_id % 7 || '.warc.gz' AS archive_file,
         CASE WHEN page_id % 6 = 0 THEN 'request' ELSE 'response' END AS rec_type,
         (2010 + page_id % 8) || '-03-01T00:00:00Z' AS record_date, url, html FROM pages)"""

HOST = "regexp_extract({}, '^(?:https?://)?([^/?#:]*)', 1)"
# Every host of the pages ends in a one-label public suffix.
DOMAIN = "regexp_extract(regexp_extract({}, '^(?:https?://)?([^/?#:]*)', 1), '([^.]+[.][^.]+)$', 1)"
PATH = "regexp_extract({}, '^(?:https?://)?[^/?#]*([^?#]*)', 1)"


def _strip(expr: str) -> str:
    """Visible text, one step at a time."""
    for pattern in ("(?s)<!--.*?-->", "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>",
                    "<[a-zA-Z/!][^>]*>", "<[a-zA-Z/!][^>]*$"):
        expr = f"regexp_replace({expr}, '{pattern}', '', 'g')"
    return f"regexp_replace({expr}, '&[a-zA-Z][a-zA-Z0-9]*;', ' ', 'g')"


PAGE_WORDS = WORDS.format(_strip("html"))
PAGES = f"""page_rows AS (
  SELECT archive_file, {DOMAIN.format('url')} AS company, CAST(substr(record_date, 1, 4) AS INTEGER) AS year,
         len(string_split({PATH.format('url')}, '/')) - 1 AS level, url AS page, {PAGE_WORDS} AS words
  FROM records WHERE rec_type = 'response')"""

PUBLIC_RAW = """public_raw AS (
  SELECT page_id AS line_no, 'g' || page_id AS gvkey, CAST(2010 + page_id % 8 AS INTEGER) AS year,
         regexp_replace(url, '/[^/]*/?$', '') AS url, page_id % 100 / 10 AS profit_assets,
         page_id % 50 / 10 AS profit_sales, page_id % 25 / 10 AS stock_return, page_id % 10 / 10 AS valuation
  FROM pages)"""

PAGE_MASTER = f"""page_master AS (
  SELECT {HOST.format('url')} || '.s' || page_id % 40 || '.com' AS company, min(page_id) AS master_id
  FROM pages GROUP BY 1)"""
PAGE_FIRM = """page_firm AS (
  SELECT 's' || page_id % 40 || '.com' AS company, max(page_id % 40) + 500 AS firm_id, '111111' AS naics
  FROM pages WHERE page_id % 40 < 25 GROUP BY 1)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- regression and overlap -------------------------------------------------------------------------

CUT = """kept AS (
  SELECT focal_firmid, rival_firmid, wtnic_score FROM (
    SELECT *, row_number() OVER (ORDER BY wtnic_score DESC, focal_firmid, rival_firmid) AS place FROM all_peers)
  WHERE place <= (SELECT floor((count(*) * (count(*) - 1)) * CAST(0.02 AS DOUBLE)) FROM public))"""
ALL_PEERS = "all_peers AS (SELECT * FROM scores WHERE focal_firmid IN (SELECT firm_id FROM public) " \
            "AND rival_firmid IN (SELECT firm_id FROM public))"
MEANS = "means AS (SELECT focal_firmid, " + ", ".join(f"avg({m}) AS rival_{m}" for m in METRICS) + \
        " FROM {} JOIN public ON rival_firmid = firm_id GROUP BY focal_firmid)"
FOCAL = ", ".join(f"{m} AS focal_{m}" for m in METRICS)
ROUNDED = ", ".join(f"round(rival_{m}, 6) AS rival_{m}" for m in METRICS) + ", " + ", ".join(
    f"round(focal_{m}, 6) AS focal_{m}" for m in METRICS)
RIVAL = ", ".join(f"rival_{m}" for m in METRICS)
LR = f"""alone AS (
  SELECT DISTINCT focal_firmid FROM all_peers WHERE focal_firmid NOT IN (SELECT focal_firmid FROM kept)),
lr AS (
  SELECT focal_firmid, {RIVAL}, {FOCAL}, 0 AS monopolist FROM means JOIN public ON focal_firmid = firm_id
  UNION ALL
  SELECT focal_firmid, 0.0, 0.0, 0.0, 0.0, {FOCAL}, 1 FROM alone JOIN public ON focal_firmid = firm_id)"""
NARROW_CUT = CUT.replace("0.02", "0.001")
NARROW_LR_INPUT = _with(VECTORS, PUBLIC, SCORES, ALL_PEERS, NARROW_CUT, MEANS.format("kept"), LR)
LR_INPUT = _with(VECTORS, PUBLIC, SCORES, ALL_PEERS, CUT, MEANS.format("kept"), LR)


def _r2(metric: str) -> str:
    """Two-predictor R² by pairwise correlations."""
    y, x, m = f"focal_{metric}", f"rival_{metric}", "monopolist"
    yx, ym, xm = f"corr({y}, {x})", f"corr({y}, {m})", f"corr({x}, {m})"
    two = f"({yx} * {yx} + {ym} * {ym} - 2 * {yx} * {ym} * {xm}) / (1 - {xm} * {xm})"
    return f"(CASE WHEN var_pop({m}) = 0 THEN {yx} * {yx} ELSE {two} END)"


CODED = """coded AS (
  SELECT p.*, CASE WHEN f.naics IS NULL OR r.naics IS NULL THEN 0
                   WHEN substr(f.naics, 1, 6) = substr(r.naics, 1, 6) THEN 6
                   WHEN substr(f.naics, 1, 5) = substr(r.naics, 1, 5) THEN 5
                   WHEN substr(f.naics, 1, 4) = substr(r.naics, 1, 4) THEN 4
                   WHEN substr(f.naics, 1, 3) = substr(r.naics, 1, 3) THEN 3
                   WHEN substr(f.naics, 1, 2) = substr(r.naics, 1, 2) THEN 2 ELSE 0 END AS match_len,
         f.naics IS NULL OR r.naics IS NULL AS missing
  FROM peers p LEFT JOIN firm f ON f.firm_id = focal_firmid LEFT JOIN firm r ON r.firm_id = rival_firmid)"""
FREQUENCY = """frequency AS (
  SELECT CAST(digits AS INTEGER) AS digits, substr(lpad(naics, CAST(greatest(6, length(naics)) AS INTEGER), '0'), 1, CAST(digits AS INTEGER)) AS prefix, count(*) AS n
  FROM firm, range(2, 7) t(digits) WHERE naics IS NOT NULL GROUP BY 1, 2)"""
REQUIRED = "required AS (SELECT digits, CAST(sum(n * (n - 1)) AS BIGINT) AS required FROM frequency GROUP BY 1)"


def _overlap(mode: str) -> str:
    event = "missing OR match_len >= digits" if mode == "reference" else "true"
    return _with(VECTORS, FIRM, SCORES, PEERS, CODED, FREQUENCY, REQUIRED) + f""", total AS (SELECT count(*) AS total_firms FROM firm),
budgets AS (
  SELECT digits, total_firms, required,
         least(CAST(floor((total_firms * (total_firms - 1)) * CAST(0.02 AS DOUBLE)) AS BIGINT), required) AS budget
  FROM required, total),
events AS (
  SELECT digits, match_len >= digits AS hit, budget,
         row_number() OVER (PARTITION BY digits ORDER BY wtnic_score DESC, focal_firmid, rival_firmid) AS place
  FROM coded, budgets WHERE {event})
SELECT '{mode}' AS mode, b.digits, total_firms, required, b.budget, coalesce(m.matches, 0) AS matches,
       CASE WHEN required > 0 THEN round(coalesce(m.matches, 0) / required, 6) END AS similarity
FROM budgets b LEFT JOIN (
  SELECT digits, count(*) FILTER (hit) AS matches FROM events WHERE place <= budget GROUP BY 1) m USING (digits)"""


def _both_codes(fraction: str) -> str:
    return f"""SELECT CAST({fraction} AS DOUBLE) AS fraction, count(*) FILTER (NOT missing AND ahead < high) AS pairs
FROM (SELECT missing, sum(CAST(missing AS INTEGER)) OVER (ORDER BY wtnic_score DESC, focal_firmid, rival_firmid) AS ahead
      FROM coded),
     (SELECT max(least(CAST(floor((t * (t - 1)) * CAST({fraction} AS DOUBLE)) AS BIGINT), required)) AS high
      FROM required, (SELECT count(*) AS t FROM firm))"""


_BAG = _with(CORPUS, FIRM_PAGES.format("corpus")) + """, placed AS (
  SELECT company, words, sum(len(words)) OVER (PARTITION BY company ORDER BY year, level, page) - len(words) AS start FROM firm_pages),
each AS (SELECT company, unnest(words) AS word, start + generate_subscripts(words, 1) - 1 AS p FROM placed)
SELECT company, CAST(p // 1000 AS BIGINT) AS line, count(*) AS n_words, string_agg(word, ' ' ORDER BY p) AS text, true AS bounded
FROM each GROUP BY 1, 2"""

_SAMPLE = "SELECT company FROM (SELECT DISTINCT company FROM url_id) ORDER BY md5(company || '17'), company LIMIT 700"

_JOINED_J1 = _with(URL_ID, CUSTOMER_FIRM) + """, listed_public AS (
  SELECT year, company, CAST(max(line_no) AS VARCHAR) AS gvkey FROM url_id WHERE year >= 1995 GROUP BY 1, 2),
public_rows AS (
  SELECT year, company, firm_id, gvkey FROM listed_public JOIN cfirm USING (company)
  WHERE company IN (SELECT c_name FROM customer WHERE c_nationkey < 20))"""

_UNKNOWN = _with(PAGE_MASTER, PAGE_FIRM) + f""", fresh AS (
  SELECT {DOMAIN.format('company')} AS company, min(master_id) AS master_id FROM page_master GROUP BY 1
  HAVING {DOMAIN.format('company')} NOT IN (SELECT company FROM page_firm))"""

_DIMENSION = _with(PUBLIC_RAW) + f""", dimension AS (
  SELECT url || '/?line=' || line_no AS company, line_no AS firm_id,
         {DOMAIN.format('url')} || replace({PATH.format("url || '/'")}, '/', '_') AS new_key FROM public_raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY new_key ORDER BY firm_id) AS place FROM dimension)"""

_METRIC_EDGES = _with(VECTORS, PUBLIC, SCORES, PEERS)

ORACLE_SQL: dict[str, str] = {
    "s1_read_archives": _with(RECORDS) + """SELECT archive_file, rec_type, record_date, url,
        CASE WHEN rec_type = 'response' THEN md5(html) END AS page_md5 FROM records""",
    "s1_read_archives_damaged": _with(RECORDS) + """SELECT CASE WHEN contains(url, '/5') THEN 'unreadable' ELSE rec_type END AS rec_type,
        CASE WHEN contains(url, '/5') THEN NULL ELSE url END AS url, count(*) AS records FROM records GROUP BY ALL""",
    "s2_read_manifest": _with(RECORDS) + """SELECT DISTINCT md5(archive_file) AS md5, archive_file AS file_name,
        '/crawl/data' AS dir, 'warc' AS container FROM records""",
    "s2_resolve_manifest": _with(RECORDS) + """SELECT DISTINCT md5(archive_file) AS md5, archive_file AS file_name,
        'warc' AS container, true AS found FROM records WHERE archive_file <> 'crawl-3.warc.gz'
        UNION ALL SELECT md5('gone.arc.gz'), 'gone.arc.gz', 'arc', false UNION ALL SELECT md5('notes.txt'), 'notes.txt', NULL, false""",
    "s3_read_public_tsv": _with(PUBLIC_RAW) + """SELECT gvkey, year, url, profit_assets, profit_sales, stock_return,
        valuation FROM public_raw""",
    "s4_read_url_id": _with(URL_ID) + """SELECT master_id, company, CAST(year AS INTEGER) AS year FROM url_id
        WHERE line_no % 31 <> 0 AND line_no % 37 <> 0""",
    "s5_read_year_list": _with(URL_ID) + "SELECT DISTINCT company FROM url_id",
    "s6_firm_dimension": _with(FIRM) + """SELECT company, firm_id, coalesce(naics, '') AS naics,
        CASE WHEN naics IS NULL THEN '' ELSE 'label' END AS obtained_from FROM firm""",
    "s7_read_corpus": _with(CORPUS) + """SELECT company, year, level, page, array_to_string(words, ' ') AS text
        FROM corpus WHERE year BETWEEN 2012 AND 2016 AND level <= 3""",
    "s8_append_corpus": _with(RECORDS, PAGES) + """SELECT company, year, level, count(*) AS pages,
        CAST(sum(len(words)) AS BIGINT) AS n_words FROM page_rows GROUP BY 1, 2, 3""",
    "s9_peer_table": _with(VECTORS, SCORES, PEERS) + "SELECT * FROM peers",
    "s10_regression_input_table": LR_INPUT + f"SELECT focal_firmid, {ROUNDED}, monopolist FROM lr",
    "s11_r2_report_json": " UNION ALL ".join(f"""SELECT * FROM ({LR_INPUT}SELECT CAST(count(DISTINCT focal_firmid) AS VARCHAR) AS no_of_docs,
        '{name}' AS input_file_name, '{label}' AS similarity, 'WTNIC' AS type,
        round(({_r2('profit_sales')} + {_r2('profit_assets')}) / 2, 6) AS "RSQ_average" FROM (SELECT * FROM lr WHERE {rows}))"""
        for name, label, rows in (("public_peers.csv", "PUBLIC", "true"), ("even.v2_peers.csv", "EVENV2", "focal_firmid % 2 = 0"))),
    "s12_overlap_report": " UNION ALL ".join(f"""SELECT o.*, b.pairs AS both_codes FROM ({_overlap(mode)}) o, (
        {_with(VECTORS, FIRM, SCORES, PEERS, CODED, FREQUENCY, REQUIRED)}{_both_codes('0.02')}) b""" for mode in ("reference", "all_pairs")),
    "s13_vector_store": _with(VECTORS) + """SELECT company, firm_id, len(v) AS dim,
        round(sqrt(list_dot_product(v, v)), 6) AS length FROM vectors""",
    "s14_year_lists": _with(URL_ID, CUSTOMER_FIRM) + """SELECT DISTINCT company, year FROM url_id
        WHERE company IN (SELECT company FROM cfirm)""",
    "s14_compiled_public_list": _with(PUBLIC) + "SELECT company, firm_id, gvkey, year FROM public",
    "s15_corpus_coverage": _with(DOC_CORPUS, FIRM_PAGES.format("doc_corpus")) + """SELECT
        lpad(CAST(vec_id AS VARCHAR), 12, '0') AS company,
        lpad(CAST(vec_id AS VARCHAR), 12, '0') IN (SELECT company FROM firm_pages WHERE len(words) > 0) AS covered
        FROM embeddings""",
    "p1_registrable_domain": f"SELECT page_id, {DOMAIN.format('url')} AS company FROM pages",
    "p1_registrable_domain_hard_hosts": """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'foo.com' WHEN 1 THEN 'foo.com' WHEN 2 THEN 'shop.co.uk'
        WHEN 3 THEN 'state.tx.us' WHEN 4 THEN 'n' || page_id || '.q.ck' ELSE 'www.ck' END AS company FROM pages""",
    "p1_registrable_domain_keep_underscore": f"""SELECT page_id, {DOMAIN.format('url')} AS company,
        {PATH.format("url || '_x'")} AS path FROM pages""",
    "p2_domain_path_key": f"SELECT page_id, {DOMAIN.format('url')} || replace({PATH.format('url')}, '/', '_') AS company FROM pages",
    "p3_flat_key": """SELECT page_id, replace(replace(replace(replace(replace(url, 'https://', ''), 'http://', ''),
        ':', '_'), '/', '_'), '?', '_') AS key FROM pages""",
    "p4_url_level": f"SELECT page_id, len(string_split({PATH.format('url')}, '/')) - 1 AS level FROM pages",
    "p5_crawl_year": """SELECT o_orderkey, year(o_orderdate) AS from_text, year(o_orderdate) AS from_time FROM orders""",
    "p6_strip_prolog": "SELECT page_id, md5(html) AS html_md5 FROM pages",
    "p7_html_text": f"SELECT page_id, {_strip('html')} AS text FROM pages",
    "p7_html_text_hard_markup": "SELECT page_id, 'AB page  number  ' || page_id || '  ' AS text FROM pages",
    "p8_words": f"SELECT page_id, array_to_string({PAGE_WORDS}, ' ') AS text FROM pages",
    "p9_normalise_words": f"SELECT doc_id, lower(array_to_string({WORDS.format('text')}, ' ')) AS text FROM documents",
    "p10_pad_naics": _with(FIRM) + "SELECT firm_id, CASE WHEN length(naics) < 6 THEN repeat('0', 6 - length(naics)) || naics ELSE naics END AS naics FROM firm",
    "p11_naics_prefixes": _with(FIRM) + """SELECT firm_id, CAST(digits AS INTEGER) AS digits,
        substr(CASE WHEN length(naics) < 6 THEN repeat('0', 6 - length(naics)) || naics ELSE naics END, 1, CAST(digits AS INTEGER)) AS prefix
        FROM firm, range(2, 7) t(digits) WHERE naics IS NOT NULL""",
    "p12_naics_match_len": _with(FIRM) + """SELECT a.firm_id, CASE
        WHEN a.naics IS NULL OR b.naics IS NULL THEN NULL
        WHEN left(a.naics, 6) = left(b.naics, 6) THEN 6 WHEN left(a.naics, 5) = left(b.naics, 5) THEN 5
        WHEN left(a.naics, 4) = left(b.naics, 4) THEN 4 WHEN left(a.naics, 3) = left(b.naics, 3) THEN 3
        WHEN left(a.naics, 2) = left(b.naics, 2) THEN 2 ELSE 0 END AS match_len
        FROM firm a JOIN firm b ON b.firm_id = a.firm_id + 1""",
    "p13_responses": _with(RECORDS) + "SELECT archive_file, url, record_date FROM records WHERE rec_type = 'response'",
    "p14_look_back": _with(CORPUS) + "SELECT company, year, level, page FROM corpus WHERE year >= 2010 AND year <= 2014",
    "p15_shallow_levels": _with(CORPUS) + "SELECT company, year, level, page FROM corpus WHERE level < 4",
    "p16_min_words": _with(DOC_CORPUS) + """SELECT company, CAST(sum(len(words)) AS BIGINT) AS n_words FROM doc_corpus
        GROUP BY 1 HAVING sum(len(words)) >= 100""",
    "p17_similarity_cut": _with(VECTORS, SCORES, PEERS) + "SELECT * FROM peers",
    "p18_valid_years": _with(URL_ID) + "SELECT line_no, company, CAST(year AS INTEGER) AS year FROM url_id WHERE year >= 1996",
    "p19_known_keys": _with(URL_ID, CUSTOMER_FIRM) + """SELECT line_no, company FROM url_id
        WHERE line_no % 9 <> 0 AND company IN (SELECT company FROM cfirm)""",
    "p20_report_labels": LR_INPUT + """SELECT CAST(count(DISTINCT focal_firmid) AS VARCHAR) AS no_of_docs,
        'doc.2vec_public_peers.csv' AS input_file_name, 'DOC2VEC' AS similarity, 'WTNIC' AS type,
        '1-25%' AS pruned_words_cutoff, '98%' AS "WTNIC_Score_Cutoff" FROM lr""",
    "j1_public_with_data": _JOINED_J1 + "SELECT CAST(year AS INTEGER) AS year, company, firm_id, gvkey FROM public_rows",
    "j2_known_companies_of_year": _with(URL_ID, CUSTOMER_FIRM) + """SELECT DISTINCT CAST(year AS INTEGER) AS year, company
        FROM url_id WHERE company IN (SELECT company FROM cfirm)""",
    "j3_master_to_firm": _with(URL_ID, CUSTOMER_FIRM) + """SELECT company, arg_min(master_id, line_no) AS master_id,
        any_value(firm_id) AS firm_id FROM url_id JOIN cfirm USING (company) GROUP BY 1""",
    "j4_unknown_companies": _UNKNOWN + "SELECT company, master_id FROM fresh",
    "j5_rival_metrics": _METRIC_EDGES + "SELECT focal_firmid, rival_firmid, wtnic_score, " + ", ".join(
        f"round({m}, 6) AS rival_{m}" for m in METRICS) + " FROM peers JOIN public ON rival_firmid = firm_id",
    "j6_focal_metrics": _METRIC_EDGES + f", {MEANS.format('peers')}, joined AS (SELECT means.*, {FOCAL} FROM means "
        f"JOIN public ON focal_firmid = firm_id) SELECT focal_firmid, {ROUNDED} FROM joined",
    "j7_public_pairs": _with(VECTORS, PUBLIC, LISTED, SCORES) + """SELECT f.firm_id AS focal_firmid, r.firm_id AS rival_firmid,
        wtnic_score FROM scores JOIN listed f ON f.firm_id = focal_firmid + 10000000
        JOIN listed r ON r.firm_id = rival_firmid + 10000000""",
    "j8_known_firm_pairs": _with(VECTORS, PUBLIC, LISTED, SCORES, PEERS) + """SELECT f.firm_id AS focal_firmid,
        r.firm_id AS rival_firmid, wtnic_score FROM peers JOIN listed f ON f.firm_id = focal_firmid + 10000000
        JOIN listed r ON r.firm_id = rival_firmid + 10000000""",
    "j9_pair_codes": _with(VECTORS, FIRM, SCORES, PEERS, CODED) + "SELECT * FROM coded",
    "j10_monopolists": NARROW_LR_INPUT + "SELECT focal_firmid FROM alone",
    "j11_unseen_records": _with(RECORDS) + """SELECT archive_file, url FROM records r WHERE rec_type = 'response'
        AND NOT EXISTS (SELECT 1 FROM records l WHERE length(l.url) % 3 = 0 AND l.archive_file = r.archive_file
        AND l.url = r.url)""",
    "j12_trained_or_inferred": _with(DOC_CORPUS) + """SELECT company, 3 AS dim, CAST(page AS BIGINT) % 2 = 0 AS is_stored
        FROM doc_corpus WHERE CAST(page AS BIGINT) % 2 = 0 OR len(words) >= 100""",
    "j12_firms_of_one_domain": _with(RECORDS, PAGES) + f""", texts AS (SELECT company FROM page_rows
        WHERE year BETWEEN 2012 AND 2016 AND level <= 3 GROUP BY 1 HAVING sum(len(words)) >= 100)
        SELECT company, count(*) AS firms, CAST(1 AS BIGINT) AS vectors
        FROM (SELECT {DOMAIN.format('url')} AS company FROM pages) JOIN texts USING (company) GROUP BY 1""",
    "j13_entity_codes": _with(PAGE_MASTER, PAGE_FIRM) + f"""SELECT {DOMAIN.format('m.company')} AS company, naics,
        count(*) AS entities FROM page_master m LEFT JOIN page_firm f ON f.company = {DOMAIN.format('m.company')}
        GROUP BY 1, 2""",
    "j13_entities_not_found": _with(PAGE_MASTER, PAGE_FIRM) + f"""SELECT DISTINCT {DOMAIN.format('company')} AS company FROM page_master
        WHERE {DOMAIN.format('company')} NOT IN (SELECT company FROM page_firm)""",
    "j14_threshold_over_clusters": _with(VECTORS, SCORES) + "SELECT * FROM scores WHERE wtnic_score >= 0.35",
    "j5_unknown_rivals": _with(VECTORS, SCORES, PEERS) + """SELECT rival_firmid, count(*) AS dropped FROM peers
        WHERE rival_firmid NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) GROUP BY 1""",
    "j14_all_pairs_cosine": _with(VECTORS, SCORES) + "SELECT * FROM scores",
    "j14_cosine_above_threshold": _with(VECTORS, SCORES, PEERS) + "SELECT * FROM peers",
    "a1_bag_of_words": _BAG,
    "a1_text_of_companies_by_domain": _with(RECORDS, PAGES, PUBLIC_RAW) + f""", listed AS (
        SELECT DISTINCT {DOMAIN.format('url')} AS domain, {DOMAIN.format('url')} || replace({PATH.format('url')}, '/', '_') AS company
        FROM public_raw)
        SELECT l.company, count(*) AS pages, CAST(sum(len(words)) AS BIGINT) AS n_words
        FROM page_rows p JOIN listed l ON p.company = l.domain
        WHERE p.year BETWEEN 2012 AND 2016 AND p.level <= 3 GROUP BY 1""",
    "a2_companies": _with(URL_ID) + """SELECT company, arg_min(master_id, line_no) AS master_id,
        array_to_string(list_sort(list(DISTINCT year)), ',') AS years, count(*) AS n_lines FROM url_id GROUP BY 1""",
    "a3_year_companies": _with(URL_ID) + "SELECT DISTINCT CAST(year AS INTEGER) AS year, company FROM url_id",
    "a4_url_id_totals": _with(URL_ID) + """SELECT count(*) AS total_lines, count(DISTINCT company) AS companies,
        count(DISTINCT (company, year)) AS company_years,
        count(DISTINCT (company, year)) FILTER (year <> 0) AS valid_years FROM url_id""",
    "a5_private_firms_per_year": _with(URL_ID, CUSTOMER_FIRM) + """SELECT CAST(year AS INTEGER) AS year,
        count(DISTINCT company) AS firms FROM url_id WHERE company IN (SELECT company FROM cfirm) GROUP BY 1""",
    "a5_public_firms_per_year": _JOINED_J1 + "SELECT CAST(year AS INTEGER) AS year, count(*) AS firms FROM public_rows GROUP BY 1",
    "a6_next_firm_id": _with(CUSTOMER_FIRM) + "SELECT max(firm_id) + 1 AS next_firm_id FROM cfirm",
    "a7_prefix_frequency": _with(FIRM, FREQUENCY) + "SELECT digits, prefix, n FROM frequency",
    "a8_required_pairs": _with(FIRM, FREQUENCY, REQUIRED) + "SELECT digits, required FROM required",
    "a9_frequency_check": _with(FIRM, FREQUENCY) + """SELECT digits, (SELECT count(naics) FROM firm) AS coded,
        CAST(sum(n) AS BIGINT) AS total, sum(n) = (SELECT count(naics) FROM firm) AS consistent
        FROM frequency GROUP BY 1""",
    "a10_entity_count": "SELECT count(DISTINCT vec_id) AS entities FROM embeddings",
    "a11_rival_means": _METRIC_EDGES + f", {MEANS.format('peers')} SELECT focal_firmid, " + ", ".join(
        f"round(rival_{m}, 6) AS rival_{m}" for m in METRICS) + " FROM means",
    "a12_focal_counts": LR_INPUT + """SELECT 'before_cut' AS stage, count(DISTINCT focal_firmid) AS focal_firms FROM all_peers
        UNION ALL SELECT 'after_cut', count(DISTINCT focal_firmid) FROM kept
        UNION ALL SELECT 'regression', count(DISTINCT focal_firmid) FROM lr""",
    "a13_naics_overlap_reference": _overlap("reference"),
    "a13_naics_overlap_all_pairs": _overlap("all_pairs"),
    "a13_pairs_with_both_codes": _with(VECTORS, FIRM, SCORES, PEERS, CODED, FREQUENCY, REQUIRED)
        + f"{_both_codes('0.02')} UNION ALL {_both_codes('0.001')}",
    "a14_r_squared": LR_INPUT + f"""SELECT count(DISTINCT focal_firmid) AS no_of_docs,
        round({_r2('stock_return')}, 6) AS "RSQ_stock_return", round({_r2('profit_sales')}, 6) AS "RSQ_profit_sales",
        round({_r2('profit_assets')}, 6) AS "RSQ_profit_asset", round({_r2('valuation')}, 6) AS "RSQ_valuation" FROM lr""",
    "a14_r_squared_with_monopolists": NARROW_LR_INPUT + f"""SELECT count(DISTINCT focal_firmid) AS no_of_docs,
        round({_r2('stock_return')}, 6) AS "RSQ_stock_return", round({_r2('profit_sales')}, 6) AS "RSQ_profit_sales",
        round({_r2('profit_assets')}, 6) AS "RSQ_profit_asset", round({_r2('valuation')}, 6) AS "RSQ_valuation" FROM lr""",
    "a15_mean_profit_r_squared": LR_INPUT + f"""SELECT round(({_r2('profit_sales')} + {_r2('profit_assets')}) / 2, 6)
        AS "RSQ_average" FROM lr""",
    "a16_vocabulary": _with(CORPUS, FIRM_PAGES.format("corpus")) + """SELECT word, count(*) AS n
        FROM (SELECT unnest(words) AS word FROM firm_pages) GROUP BY 1 HAVING count(*) >= 5""",
    "a17_latest_public_rows": _with(PUBLIC_RAW) + f""", keyed AS (SELECT *, {DOMAIN.format('url')}
        || replace({PATH.format('url')}, '/', '_') AS company FROM public_raw)
        SELECT year, company, gvkey, profit_assets, profit_sales, stock_return, valuation FROM keyed
        QUALIFY row_number() OVER (PARTITION BY year, company ORDER BY line_no DESC) = 1""",
    "a17_last_line_wins_over_files": _with(PUBLIC_RAW) + f""", keyed AS (SELECT *, {DOMAIN.format('url')}
        || replace({PATH.format('url')}, '/', '_') AS company FROM public_raw)
        SELECT year, company, gvkey, profit_assets FROM keyed
        QUALIFY row_number() OVER (PARTITION BY year, company ORDER BY line_no % 3 DESC, line_no DESC) = 1""",
    "a18_rekeyed_dimension": _DIMENSION + "SELECT new_key AS company, firm_id FROM ranked WHERE place = 1",
    "a18_rekeyed_repeats": _DIMENSION + "SELECT company, new_key FROM ranked WHERE place > 1",
    "a19_run_metrics": _with(RECORDS) + f"""SELECT archive_file, count(*) AS records,
        count(*) FILTER (rec_type = 'response') AS responses,
        count(DISTINCT url) FILTER (rec_type = 'response') AS urls,
        CAST(coalesce(sum(len({PAGE_WORDS})) FILTER (rec_type = 'response'), 0) AS BIGINT) AS n_words
        FROM records GROUP BY 1""",
    "a19_ingest_account": _with(RECORDS) + f""", read_ AS (
        SELECT *, contains(url, '/5') AS broken, len({PAGE_WORDS}) AS words FROM records WHERE archive_file <> 'crawl-2.warc.gz')
        SELECT archive_file, count(*) AS records, count(*) FILTER (NOT broken AND rec_type = 'response') AS responses,
        count(*) FILTER (broken) AS unreadable, count(*) FILTER (NOT broken AND rec_type = 'response') AS pages,
        CAST(coalesce(sum(words) FILTER (NOT broken AND rec_type = 'response'), 0) AS BIGINT) AS n_words, false AS missing
        FROM read_ GROUP BY 1 UNION ALL SELECT 'gone.warc.gz', 0, 0, 0, 0, 0, true""",
    "w1_new_firm_ids": _UNKNOWN + """SELECT company, master_id, row_number() OVER (ORDER BY master_id, company)
        + (SELECT max(firm_id) FROM page_firm) AS firm_id FROM fresh""",
    "w2_top_k_rivals": _with(VECTORS, PUBLIC, LISTED, SCORES) + """, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY focal_firmid ORDER BY wtnic_score DESC, CAST(rival_firmid AS VARCHAR)) AS place
        FROM scores)
        SELECT f.firm_id AS focal_firmid, r.firm_id AS rival_firmid, wtnic_score FROM ranked
        JOIN listed f ON f.firm_id = focal_firmid + 10000000 JOIN listed r ON r.firm_id = rival_firmid + 10000000
        WHERE place <= 39""",
    "w3_top_percent_rivals": _with(VECTORS, PUBLIC, LISTED, SCORES) + """, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY focal_firmid ORDER BY wtnic_score DESC, CAST(rival_firmid AS VARCHAR)) AS place
        FROM scores)
        SELECT f.firm_id AS focal_firmid, r.firm_id AS rival_firmid, wtnic_score FROM ranked
        JOIN listed f ON f.firm_id = focal_firmid + 10000000 JOIN listed r ON r.firm_id = rival_firmid + 10000000
        WHERE wtnic_score >= 0.1 AND place <= (SELECT floor(count(*) * CAST(1.5 AS DOUBLE) / 100) FROM vectors)""",
    "l1_global_top_fraction": LR_INPUT + "SELECT * FROM kept",
    "l1_top_fraction_of_vector_pairs": LR_INPUT + "SELECT * FROM kept",
    "l1_top_fraction_of_lineitem": """SELECT l_orderkey, l_linenumber, l_quantity FROM (
        SELECT l_orderkey, l_linenumber, l_quantity,
               row_number() OVER (ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS place FROM lineitem)
        WHERE place <= (SELECT floor(count(*) * CAST(0.02 AS DOUBLE)) FROM lineitem)""",
    "l1_top_fraction_with_missing_scores": """SELECT l_orderkey, l_linenumber, score FROM (
        SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, l_orderkey, l_linenumber) AS place FROM (
          SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 >= 3 THEN CAST(l_discount AS DOUBLE) END AS score FROM lineitem))
        WHERE place <= (SELECT floor(count(*) * CAST(0.7 AS DOUBLE)) FROM lineitem)""",
    "l2_sorted_peers": _with(VECTORS, SCORES, PEERS) + "SELECT * FROM peers ORDER BY wtnic_score DESC, focal_firmid, rival_firmid",
    "l3_hash_sample": _with(URL_ID) + _SAMPLE,
    "l4_ordered_pages": _with(CORPUS) + """SELECT company, year, level, page,
        row_number() OVER (PARTITION BY company ORDER BY year, level, page) AS position FROM corpus""",
    "u1_training_set": _with(URL_ID, CUSTOMER_FIRM) + f"SELECT company FROM ({_SAMPLE}) UNION SELECT company FROM cfirm",
    "u2_not_indexed": _with(URL_ID, CUSTOMER_FIRM) + "SELECT company FROM url_id EXCEPT SELECT company FROM cfirm",
    "u3_regression_input": LR_INPUT + f"SELECT focal_firmid, {ROUNDED}, monopolist FROM lr",
    "u3_regression_input_with_monopolists": NARROW_LR_INPUT + f"SELECT focal_firmid, {ROUNDED}, monopolist FROM lr",
    "u4_all_vectors": _with(VECTORS) + """SELECT company, CASE WHEN firm_id % 3 = 0 THEN 'trained' ELSE 'inferred' END AS origin,
        round(sqrt(list_dot_product(v, v)), 6) AS length FROM vectors""",
    "m1_word_vectors": _with(DOC_CORPUS, FIRM_PAGES.format("doc_corpus")) + """SELECT word, 32 AS dim, true AS has_direction
        FROM (SELECT unnest(words) AS word FROM firm_pages) GROUP BY 1 HAVING count(*) >= 5""",
    "m2_firm_vectors": _with(DOC_CORPUS, FIRM_PAGES.format("doc_corpus")) + """SELECT company, 32 AS dim,
        CAST(sum(len(words)) AS BIGINT) AS n_words, CAST(0 AS DOUBLE) AS deviation FROM firm_pages GROUP BY 1
        HAVING sum(len(words)) > 0""",
    "m3_cosine_with_next": _with(VECTORS) + """SELECT a.firm_id, round(list_cosine_similarity(a.v, b.v), 6) AS score
        FROM vectors a JOIN vectors b ON b.firm_id = a.firm_id + 1""",
    "t1_incremental_ingest": _with(RECORDS, PAGES) + """SELECT company, year, level, page,
        array_to_string(words, ' ') AS text FROM page_rows""",
    "t1_incremental_ingest_with_repeats": _with(RECORDS, PAGES) + """, offered AS (
        SELECT * FROM page_rows WHERE archive_file <= 'crawl-4' UNION ALL
        SELECT * FROM page_rows WHERE archive_file >= 'crawl-3')
        SELECT company, year, level, page, array_to_string(words, ' ') AS text FROM offered""",
}
