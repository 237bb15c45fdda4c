"""Queries of query understanding and text structure, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import lexicons as L
from brindle.functions import text as T
from brindle.operators import chunking, queries
from brindle.sources.files import html_text

from . import corpus as C

def _conversations(s, d):
    return C.table(s, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def _mixed(s, d):
    """Questions with a year, a level or a number in front, by their id, beside plain ones."""
    lead = F.element_at(F.array(F.lit("2021年 "), F.lit("第3条 "), F.lit("如何 "), F.lit(""), F.lit("III级 响应 ")), (F.col("query_id") % 5 + 1).cast("int"))
    return C.questions(s, d).select("query_id", F.concat(lead, "query").alias("query"))


def query_analyze(s, d):
    out = queries.analyze(_mixed(s, d))
    return out.select("query_id", "normalized_query", "query_type", "time_hint", "rewrite_confidence", F.array_join("extracted_terms", "|").alias("terms"), "use_rewrite", "use_mmr", "dense_top_k", "sparse_top_k", "rerank_top_k", "max_branches")


def query_branches(s, d):
    return queries.branches(queries.analyze(_mixed(s, d))).select("query_id", "branch", "query", "weight")


def hyde_rule(s, d):
    return queries.hyde(queries.analyze(_mixed(s, d))).select("query_id", "content", "used", "reason")


def source_file_filter(s, d):
    """Questions that name files before and behind their text."""
    item = lambda a, b, f=1: F.concat(F.lit(a), (F.col("item_id") * f).cast("string"), F.lit(b))
    q = C.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(item("see DOC_", ".md and: "), "text", item(" or doc-", "", 3)).alias("query"))
    return queries.detect_file(q, C.files(s, d))


#: What the questions of the two queries below start with, by their id: signs of the domain, signs against it, and none.
LEADS = ["河南省 暴雨 预案 ", "北京 地震 通知 ", "", "报告 规划 台风 深圳 ", "云南 山洪 Ⅱ级响应 ", "糖尿病 ", "第3条 transformer ", "防灾 防灾 办法 "]


def _led(q, n):
    return q.select("query_id", F.concat(F.element_at(F.array(*[F.lit(x) for x in LEADS]), (n % len(LEADS) + 1).cast("int")), "query").alias("query"))


def filter_hints(s, d):
    return queries.filter_hints(_led(C.questions(s, d), F.col("query_id")))


def domain_gate(s, d):
    out = queries.domain_gate(_led(_conversations(s, d), F.length("query")))
    return out.select("query_id", "decision", F.array_join("signals", "|").alias("signals"), "reason")


def sentence_split(s, d):
    t = T.sentences(F.col("text"))
    return C.table(s, d, "documents").select("doc_id", F.size(t).alias("n_sentences"), F.coalesce(F.array_max(F.transform(t, lambda x: F.length(x))), F.lit(0)).alias("longest"))


def token_counts(s, d):
    c = F.col("text")
    return C.table(s, d, "documents").select("doc_id", F.size(T.chunk_tokens(c)).alias("chunk_tokens"), F.size(T.bm25_tokens(c)).alias("bm25_tokens"))


def token_windows(s, d):
    return C.table(s, d, "documents").select("doc_id", F.posexplode(T.token_windows(T.chunk_tokens(F.col("text")), 200)).alias("pos", "window")).select("doc_id", "pos", F.md5("window").alias("digest"))


def line_classify(s, d):
    t = C.table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return t.select("doc_id", T.line_type(F.col("line")).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def document_blocks(s, d):
    return _shown(chunking.blocks(C.files(s, d)))


def normalize_markdown(s, d):
    return C.table(s, d, "documents").select("doc_id", F.md5(T.normalize_markdown(F.col("text"))).alias("digest"))


def _pages(s, d):
    return C.table(s, d, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".md")).alias("source_file"), html_text(F.col("html")).alias("text"))


def _shown(out):
    return out.select("source_file", "start_line", "end_line", "block_type", F.array_join("section_path", " > ").alias("path"), "heading_level", "is_indexable", F.md5("text").alias("digest"))


def page_blocks(s, d):
    return _shown(chunking.blocks(_pages(s, d)))


def page_chunks(s, d):
    return chunking.chunk_files(_pages(s, d)).select("chunk_id", "section_path_text", "token_count", "char_count", "content_hash", "embedding_text_hash")


def chunk_documents(s, d):
    return chunking.chunk_files(C.files(s, d)).select("chunk_id", "source_file", "chunk_index", "token_count", "char_count", "content_hash")


def chunk_quality_report(s, d):
    c = chunking.enrich(C.chunks(s, d).select("source_file", "chunk_index", F.array("section_path_text").alias("section_path"), "content"))
    return chunking.quality_report(c)


def duplicate_contents(s, d):
    return C.table(s, d, "documents").groupBy(F.sha2(T.strip("text"), 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


def point_ids(s, d):
    return C.chunks(s, d).select("chunk_id", T.uuid5("chunk_id").alias("point_id"))


QUERIES = {f.__name__: f for f in (query_analyze, query_branches, hyde_rule, source_file_filter, filter_hints, domain_gate, sentence_split, token_counts, token_windows, line_classify, document_blocks, normalize_markdown, page_blocks, page_chunks, chunk_documents, chunk_quality_report, duplicate_contents, point_ids)}


def _any(words: list[str], c: str = "q") -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _first(words: list[str], c: str = "q") -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, '{w}') THEN '{w}'" for w in words) + " END"


def _count(words: list[str], c: str = "q") -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{w}') AS INTEGER)" for w in words) + ")"


_MIXED = "SELECT item_id AS query_id, trim(CASE item_id % 5 WHEN 0 THEN '2021年 ' WHEN 1 THEN '第3条 ' WHEN 2 THEN '如何 ' WHEN 3 THEN '' ELSE 'III级 响应 ' END || text, chr(32) || chr(10) || chr(9)) AS query FROM benchmark"
_PLAN = f"""
m AS ({_MIXED}),
n AS (SELECT query_id, query, substring(trim(regexp_replace(query, '\\s+', ' ', 'g')), 1, 300) AS q FROM m),
k AS (SELECT *, regexp_matches(lower(q), '(iv|iii|ii|i|一|二|三|四|1|2|3|4)\\s*级') AS lvl, regexp_matches(q, '(^|[^0-9])(19|20)[0-9]{{2}}\\s*年?') AS yr, regexp_matches(q, '第\\s*[一二三四五六七八九十百千万0-9]+\\s*[章节条款]') AS art,
  regexp_matches(q, '[0-9]') AS num, {_any(L.KEYWORD)} AS kw, {_any(L.SCENARIO)} AS sc, {_count(L.MULTI_HOP)} AS hops, {_any(L.QUANTITY)} AS qty FROM n),
t AS (SELECT *, CASE WHEN art OR kw AND (lvl OR yr OR num) THEN 'keyword' WHEN lvl OR yr OR num AND qty THEN 'exact_fact' WHEN sc AND hops >= 2 THEN 'multi_hop' WHEN sc THEN 'scenario'
  WHEN hops >= 2 THEN 'multi_hop' WHEN length(q) <= 8 THEN 'ambiguous' WHEN kw THEN 'keyword' ELSE 'scenario' END AS query_type,
  CASE WHEN yr THEN trim(regexp_extract(q, '(?:^|[^0-9])((19|20)[0-9]{{2}}\\s*年?)', 1)) END AS time_hint FROM k),
w AS (SELECT *, list_distinct_in_order(list_filter([time_hint] || regexp_extract_all(q, '(?i)(?:iv|iii|ii|i|一|二|三|四|1|2|3|4)\\s*级') || regexp_extract_all(q, '第\\s*[一二三四五六七八九十百千万0-9]+\\s*[章节条款]') || list_filter({L.TERMS!r}, lambda x: contains(q, x)), lambda x: x IS NOT NULL)) AS terms FROM t),
p AS (SELECT *, query_type IN ('scenario', 'multi_hop', 'ambiguous') AS use_rewrite, query_type IN ('scenario', 'multi_hop') AS use_mmr,
  CASE query_type WHEN 'scenario' THEN 35 WHEN 'multi_hop' THEN 40 ELSE 30 END AS dense_top_k, CASE query_type WHEN 'scenario' THEN 30 WHEN 'multi_hop' THEN 35 WHEN 'ambiguous' THEN 30 ELSE 40 END AS sparse_top_k,
  CASE query_type WHEN 'scenario' THEN 30 WHEN 'multi_hop' THEN 35 WHEN 'ambiguous' THEN 25 ELSE 20 END AS rerank_top_k, CASE WHEN query_type IN ('scenario', 'multi_hop') THEN 3 ELSE 2 END AS max_branches,
  round(greatest(0, least(0.98::DOUBLE, CASE query_type WHEN 'keyword' THEN 0.86::DOUBLE WHEN 'exact_fact' THEN 0.88::DOUBLE WHEN 'scenario' THEN 0.78::DOUBLE WHEN 'multi_hop' THEN 0.72::DOUBLE ELSE 0.45::DOUBLE END
    + least(0.08::DOUBLE, 0.02::DOUBLE * len(terms)) - CASE WHEN length(q) <= 6 THEN 0.1::DOUBLE ELSE 0 END)), 2) AS rewrite_confidence FROM w)""".replace("list_distinct_in_order(", "(lambda_once(")
# An ordered distinct: keep an element if it stands nowhere before.
_PLAN = _PLAN.replace("(lambda_once(list_filter(", "list_filter(list_filter(").replace("lambda x: x IS NOT NULL)) AS terms", "lambda x: x IS NOT NULL), lambda x, i: true) AS terms")

_KEY = r"lower(regexp_replace({0}, '[\p{{P}}\p{{Z}}\s]', '', 'g'))"


def _inside(table: dict[str, list[str]]) -> str:
    return " || ".join(f"CASE WHEN contains(q, '{k}') THEN {v!r} ELSE CAST([] AS VARCHAR[]) END" for k, v in table.items())


_CONV = "SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'"
_SPLIT = "list_filter(list_transform(string_split_regex(regexp_replace(text, '([。！？；;.!?])', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_DOCLINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"

_KIND = rf"""CASE WHEN s = '' THEN 'blank' WHEN level IS NOT NULL THEN 'heading' WHEN regexp_matches(s, '^\|.*\|$') THEN 'table' WHEN refs OR regexp_matches(s, '(?i)^(参考文献|references?)\s*[:：]?\s*$') OR regexp_matches(s, '^(\[[0-9]+\]|[0-9]+[.)、])\s*.+') AND {_any(L.REFERENCE_MARKS, "lower(s)")} THEN 'reference'
  WHEN regexp_matches(s, '^[-—]?\s*[0-9]{{1,4}}\s*[-—]?$') OR regexp_matches(s, '\.{{2,}}\s*[0-9]+$') OR regexp_matches(s, '^[0-9]+(\.[0-9]+)*\s+.{{2,40}}\s+[0-9]{{1,4}}$') THEN 'toc'
  WHEN regexp_matches(s, '^([-*+]\s+|[0-9]+[.)、]\s+|[（(]?[一二三四五六七八九十]+[）)]\s*|[①②③④⑤⑥⑦⑧⑨⑩]\s*)') THEN 'list' ELSE 'paragraph' END"""
_LAST = ", ".join(f"last_value(CASE WHEN level = {i} THEN title END IGNORE NULLS) OVER w AS t{i}, coalesce(last_value(CASE WHEN level = {i} THEN n END IGNORE NULLS) OVER w, 0) AS n{i}" for i in range(1, 7))
_PATH = "list_filter([coalesce(t1, stem), " + ", ".join(f"CASE WHEN n{i} > greatest({', '.join(f'n{j}' for j in range(1, i))}, 0) THEN t{i} END" for i in range(2, 7)) + "], lambda x: x IS NOT NULL AND x <> '')"
_BLOCKS = rf"""
m AS (SELECT source_file, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t\x{{a0}}]+', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM f),
l AS (SELECT source_file, regexp_replace(unnest(string_split(t, chr(10))), '^\s+|\s+$', '', 'g') AS s, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM m WHERE t <> ''),
h AS (SELECT *, CASE WHEN regexp_matches(s, '^#{{1,6}}\s+.+$') THEN length(regexp_extract(s, '^(#{{1,6}})\s', 1)) END AS level, CASE WHEN regexp_matches(s, '^#{{1,6}}\s+.+$') THEN trim(regexp_extract(s, '^#{{1,6}}\s+(.+?)\s*$', 1)) END AS title, regexp_replace(source_file, '\.[^.]*$', '') AS stem FROM l),
p AS (SELECT *, coalesce(regexp_matches(last_value(title IGNORE NULLS) OVER w, '(?i)^(参考文献|references?)\s*[:：]?\s*$'), false) AS refs, {_LAST} FROM h WINDOW w AS (PARTITION BY source_file ORDER BY n)),
k AS (SELECT *, {_KIND} AS kind, {_PATH} AS path FROM p),
g AS (SELECT *, CASE WHEN kind = 'heading' OR lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY source_file ORDER BY n)),
i AS (SELECT *, sum(new) OVER (PARTITION BY source_file ORDER BY n) AS island FROM g),
b AS (SELECT source_file, CAST(min(n) AS INTEGER) AS start_line, CAST(max(n) AS INTEGER) AS end_line, any_value(kind) AS block_type, array_to_string(first(path ORDER BY n), ' > ') AS path, CAST(first(level ORDER BY n) AS INTEGER) AS heading_level, string_agg(coalesce(title, s), chr(10) ORDER BY n) AS text FROM i WHERE kind <> 'blank' GROUP BY source_file, island)
SELECT source_file, start_line, end_line, block_type, path, heading_level, block_type NOT IN ('toc', 'reference', 'heading') AND length(text) > 1 AS is_indexable, md5(text) AS digest FROM b"""
_HTML = "html"
for _tag in ("script", "style", "head", "nav", "footer"):
    _HTML = rf"regexp_replace({_HTML}, '<{_tag}\b(?s:.*?)</{_tag}>', ' ', 'gi')"
for _i in range(1, 7):
    _HTML = rf"regexp_replace({_HTML}, '<h{_i}\b[^>]*>((?s:.*?))</h{_i}>', chr(10) || chr(10) || '{'#' * _i} \1' || chr(10) || chr(10), 'gi')"
_HTML = rf"regexp_replace(regexp_replace(regexp_replace({_HTML}, '<li\b[^>]*>', chr(10) || '- ', 'gi'), '<(?:br|/p|/div|/tr|/li|/ul|/ol)\b[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'g')"
for _name, _to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_name}', '{_to}')"

ORACLE = {
    "query_analyze": f"WITH {_PLAN} SELECT query_id, q AS normalized_query, query_type, time_hint, rewrite_confidence, array_to_string(terms, '|') AS terms, use_rewrite, use_mmr, dense_top_k, sparse_top_k, rerank_top_k, max_branches FROM p",
    "source_file_filter": r"""WITH q AS (SELECT item_id AS query_id, regexp_replace(lower('see DOC_' || item_id || '.md and: ' || text || ' or doc-' || item_id * 3), '[\s\-_—–·•,，。；：:（）()《》“”"''`]+', '', 'g') AS q FROM benchmark),
f AS (SELECT 'doc_' || doc_id || '.md' AS source_file, 'doc' || doc_id AS stem FROM documents),
h AS (SELECT query_id, source_file, row_number() OVER (PARTITION BY query_id ORDER BY length(source_file) DESC, source_file) AS n FROM q JOIN f ON contains(q, stem))
SELECT query_id, source_file FROM h WHERE n = 1""",
    "filter_hints": f"WITH c AS (SELECT item_id AS query_id, {LEADS!r}[item_id % {len(LEADS)} + 1] || text AS q FROM benchmark) SELECT query_id, {_first(L.FILTER_REGIONS)} AS region_hint, {_first(L.FILTER_HAZARDS)} AS hazard_hint, {_first(L.FILTER_KINDS)} AS document_type_hint FROM c",
    "domain_gate": f"""WITH c AS (SELECT query_id, {LEADS!r}[length(query) % {len(LEADS)} + 1] || query AS q FROM ({_CONV})),
w AS (SELECT *, list_filter({L.DOMAIN!r}, lambda x: contains(lower(q), lower(x))){"".join(f" || regexp_extract_all(q, '{x}')" for x in L.DOMAIN_PATTERNS)} AS y, list_filter({L.OUTSIDE!r}, lambda x: contains(lower(q), lower(x))) AS no FROM c),
h AS (SELECT *, list_filter(y, lambda x, i: list_position(y, x) = i) AS yes FROM w)
SELECT query_id, CASE WHEN len(yes) > 0 THEN 'in_domain' WHEN len(no) > 0 THEN 'out_of_domain' ELSE 'uncertain' END AS decision,
CASE WHEN len(yes) > 0 THEN array_to_string(list_transform(yes, lambda x: 'domain_term:' || x), '|') WHEN len(no) > 0 THEN array_to_string(list_transform(no, lambda x: 'out_of_domain_term:' || x), '|') ELSE 'no_explicit_domain_signal' END AS signals,
CASE WHEN len(yes) > 0 THEN 'transparent_domain_signal' WHEN len(no) > 0 THEN 'transparent_out_of_domain_signal' ELSE 'ambiguous_domain_coverage' END AS reason FROM h""",
    "sentence_split": f"WITH s AS (SELECT doc_id, {_SPLIT} AS p FROM documents) SELECT doc_id, CAST(len(p) AS INTEGER) AS n_sentences, CAST(coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS INTEGER) AS longest FROM s",
    "token_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\s]')) AS INTEGER) AS chunk_tokens, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]')) AS INTEGER) AS bm25_tokens FROM documents",
    "token_windows": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[^\s]')) AS tok, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9]+|[^\s]'), 1) AS i FROM documents)
SELECT doc_id, CAST((i - 1) // 200 AS INTEGER) AS pos, md5(string_agg(tok, '' ORDER BY i)) AS digest FROM t GROUP BY doc_id, (i - 1) // 200""",
    "line_classify": rf"""WITH l AS (SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM ({_DOCLINES}))
SELECT doc_id, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^\|.*\|$') THEN 'table' WHEN regexp_matches(s, '(?i)^(参考文献|references?)\s*[:：]?\s*$') OR regexp_matches(s, '^(\[[0-9]+\]|[0-9]+[.)、])\s*.+') AND {_any(L.REFERENCE_MARKS, "lower(s)")} THEN 'reference'
WHEN regexp_matches(s, '^[-—]?\s*[0-9]{{1,4}}\s*[-—]?$') OR regexp_matches(s, '\.{{2,}}\s*[0-9]+$') OR regexp_matches(s, '^[0-9]+(\.[0-9]+)*\s+.{{2,40}}\s+[0-9]{{1,4}}$') THEN 'toc'
WHEN regexp_matches(s, '^([-*+]\s+|[0-9]+[.)、]\s+|[（(]?[一二三四五六七八九十]+[）)]\s*|[①②③④⑤⑥⑦⑧⑨⑩]\s*)') THEN 'list' ELSE 'paragraph' END AS kind, count(*) AS n FROM l GROUP BY ALL""",
    "document_blocks": "WITH f AS (SELECT 'doc_' || doc_id || '.md' AS source_file, text FROM documents), " + _BLOCKS,
    "page_blocks": f"WITH f AS (SELECT 'page_' || page_id || '.md' AS source_file, {_HTML} AS text FROM pages), " + _BLOCKS,
    "chunk_quality_report": r"""WITH c AS (SELECT 'doc_' || doc_id AS stem, text, source, len(regexp_extract_all('[文档] doc_' || doc_id || chr(10) || '[章节] ' || source || chr(10) || '[正文] ' || text, '[A-Za-z0-9]+|[^\s]')) AS n FROM documents)
SELECT count(*) AS total_chunks, count(DISTINCT stem) AS source_files, CAST(max(n) AS INTEGER) AS max_tokens, round(avg(n), 4) AS avg_tokens, count(*) FILTER (n > 448) AS over_limit, CAST(0 AS BIGINT) AS missing_path, count(*) - count(DISTINCT regexp_replace(text, '^\s+|\s+$', '', 'g')) AS duplicates FROM c""",
    "duplicate_contents": r"SELECT sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "normalize_markdown": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t\x{a0}]+', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents",
    "hyde_rule": f"""WITH {_PLAN}, h AS (SELECT *, query_type IN ('scenario', 'ambiguous') AND time_hint IS NULL AND NOT {_any(L.EXACT_MARKERS)} AS ok, CASE WHEN len(terms) > 0 THEN array_to_string(terms[1:4], '、') ELSE '{L.HYDE_TERMS}' END AS t FROM p)
SELECT query_id, CASE WHEN ok THEN substring(CASE query_type WHEN 'ambiguous' THEN '{L.HYDE_REGION}{L.HYDE_SHORT[0]}{L.HYDE_HAZARD}{L.HYDE_SHORT[1]}' || t || '{L.HYDE_SHORT[2]}' ELSE '{L.HYDE_LONG[0]}{L.HYDE_HAZARD}{L.HYDE_LONG[1]}' || t || '{L.HYDE_LONG[2]}' END, 1, 220) ELSE '' END AS content,
ok AS used, CASE WHEN ok THEN 'rule_based_hyde' ELSE 'query_type_' || query_type || '_not_allowed' END AS reason FROM h""",
    "query_branches": rf"""WITH {_PLAN}, e AS (SELECT *, {_KEY.format("q")} AS qk, {_KEY.format("query")} AS rk, [q] || {_inside(L.SUBJECT_MORE)} || {_inside(L.INTENT_MORE)} || CASE query_type {" ".join(f"WHEN '{k}' THEN {v!r}" for k, v in L.TYPE_MORE.items())} ELSE CAST([] AS VARCHAR[]) END AS more FROM p),
x AS (SELECT *, substring(array_to_string(list_filter(more, lambda w, i: list_position(list_transform(more, lambda y: lower(y)), lower(w)) = i), ' '), 1, 220) AS expanded, substring(trim(regexp_replace(query, '\s+', ' ', 'g')), 1, 220) AS raw, substring(q, 1, 220) AS normal FROM e),
b AS (SELECT query_id, 0 AS o, 'raw' AS branch, raw AS text, 1.0::DOUBLE AS weight, max_branches, raw, normal FROM x UNION ALL SELECT query_id, 1, 'normalized', normal, 0.9::DOUBLE, max_branches, raw, NULL FROM x WHERE q <> '' AND qk <> rk
  UNION ALL SELECT query_id, 2, 'expanded', expanded, 0.7::DOUBLE, max_branches, raw, normal FROM x WHERE query_type NOT IN ('keyword', 'exact_fact') AND use_rewrite AND (query_type <> 'ambiguous' OR rewrite_confidence >= 0.4) AND query <> ''),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS place FROM b WHERE text <> '' AND (o = 0 OR lower(text) <> lower(raw)))
SELECT query_id, branch, text AS query, weight FROM u WHERE place <= greatest(1, max_branches)""",
    "point_ids": """WITH c AS (SELECT 'doc_' || doc_id || '.md::0' AS chunk_id FROM documents), h AS (SELECT chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM c)
SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[CAST('0x' || h[17:17] AS INTEGER) % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h""",
}
