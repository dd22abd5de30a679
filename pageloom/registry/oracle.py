r"""The same results as plain SQL, for DuckDB on the same tables.

Written from the definitions and not from the Spark plans: recursive queries stand in for the
packing and the traversal, ranking windows for grouped minima, and markers for the look-behind
that DuckDB's regular expressions lack.
"""

from __future__ import annotations

from pageloom.functions.prompts import ANSWER_ROLE
from pageloom.operators.scores import DEFAULT_CHUNK_SIZE, DEFAULT_MODEL, POISSON_STEPS
from pageloom.schemas import METADATA_FIELDS

DIM = 64
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"

# The cleaning rules, plainly.
CLEANING = [
    (r"[^\x00-\x7F]", ""),
    (r"http[s]?://\S+", ""),
    (r"\S+@\S+", ""),
    (r"\[\d+(-\d+)?(,\s*\d+(-\d+)?)*\]", ""),
    (r"\b\d+\.\d+([eE][-+]?\d+)?\s*mg\b", ""),
    (r"\b\d+\.\d+([eE][-+]?\d+)?\b", ""),
    (r"\[[Jj]\]\.", ""),
    (r"\b([A-Z][a-z]*\b\.?\s*){1,4}(\d{4}).*?\d+", ""),
    (r"\s*([,.!?])\s*", r"\1 "),
    (r"\b([A-Z]\.)\s*", r"\1"),
    (r"[\s\x0b\x1c-\x1f]+", " "),
]


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {text_literal(pattern)}, {text_literal(by)}, 'g')"


def clean(x: str, steps: int = len(CLEANING)) -> str:
    for pattern, by in CLEANING[:steps]:
        x = replaced(x, pattern, by)
    return f"trim({x})" if steps == len(CLEANING) else x


def strip(x: str) -> str:
    return replaced(x, f"^{BLANK}+|{BLANK}+$", "")


def split(x: str) -> str:
    """List of sentences: mark each candidate, take back the exceptions, split at the marks."""
    x = f"regexp_replace({x}, '([.?])({BLANK})', '\\1' || chr(1) || '\\2', 'g')"
    x = f"regexp_replace({x}, '({WORD}\\.{WORD}[.?])' || chr(1), '\\1', 'g')"
    x = f"regexp_replace({x}, '([A-Z][a-z]\\.)' || chr(1), '\\1', 'g')"
    parts = f"string_split_regex({x}, chr(1) || '{BLANK}')"
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: length(s) > 0)"


def tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^\\s\\x0b]+'))"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def exploded(source: str, keys: str, lst: str, name: str = "sentence") -> str:
    """Rows (keys, pos, name) of a list expression over ``source``."""
    return (
        f"SELECT {keys}, pos - 1 AS pos, lst[pos] AS {name} FROM (SELECT {keys}, lst, unnest(range(1, len(lst) + 1)) AS pos "
        f"FROM (SELECT {keys}, {lst} AS lst FROM {source}))"
    )


def first_kept(lst: str) -> str:
    """Distinct list elements in order of first occurrence."""
    return f"list_transform(list_sort(list_transform(list_distinct({lst}), lambda v: [list_position({lst}, v)])), lambda i: ({lst})[i[1]])"


# sent(doc_id, pos, sentence): distinct sentences of the cleaned documents, first copy kept
SENT = f"""raw AS ({exploded('documents', 'doc_id, lang', split(clean('text')))}),
sent AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, sentence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY pos) AS copy FROM raw) WHERE copy = 1)"""


def packed(size: int, sent: str = "sent", keys: str = "doc_id", counted: str | None = None) -> str:
    """packed: every sentence with its chunk number, by recursion over the sentences of a document."""
    key_join = " AND ".join(f"s.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    s_keys = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    counted = counted or f"SELECT {keys}, pos, sentence, {tokens('sentence')} AS n FROM {sent}"
    return f"""counted AS MATERIALIZED ({counted}),
walk AS (
  SELECT {keys}, pos, n, 0 AS chunk_no, n AS held FROM counted WHERE pos = 0
  UNION ALL
  SELECT {s_keys}, s.pos, s.n,
    CASE WHEN c.held + s.n + 2 > {size} AND c.held > 0 THEN c.chunk_no + 1 ELSE c.chunk_no END,
    CASE WHEN c.held + s.n + 2 > {size} THEN s.n ELSE c.held + s.n END
  FROM walk c JOIN counted s ON {key_join} AND s.pos = c.pos + 1)"""


def chunked(size: int, keys: str = "doc_id") -> str:
    return f"""{packed(size, keys=keys)},
chunk AS (SELECT {keys}, chunk_no, count(*) AS n_sentences, sum(w.n)::BIGINT AS n_tokens,
  string_agg(sentence, ' ' ORDER BY pos) AS content, list(sentence ORDER BY pos) AS sentences
  FROM walk w JOIN counted USING ({keys}, pos) GROUP BY {keys}, chunk_no)"""


POINT_ID = "(doc_id * 16777216 + chunk_no)"


def summarised(source: str, to: str = "summed") -> str:
    """to(id, summary) of chunks (id, n_sentences, sentences)."""
    return f"""{to}_rows AS (SELECT id, n_sentences, unnest(range(0, len(sentences))) AS ord, unnest(sentences) AS sentence FROM {source}),
{to}_terms AS (SELECT id, n_sentences, ord, term, count(*) AS n FROM (SELECT id, n_sentences, ord, unnest({words('sentence')}) AS term FROM {to}_rows) GROUP BY ALL),
{to}_weighted AS (SELECT *, sum(n) OVER (PARTITION BY id, term) * ln(1 + n_sentences / count(*) OVER (PARTITION BY id, term)) AS weight FROM {to}_terms),
{to}_scored AS (SELECT id, ord, round(sum(n * weight) / sum(n), 9) AS score FROM {to}_weighted GROUP BY ALL),
{to}_ranked AS (SELECT id, ord, sentence, row_number() OVER best AS rank, sum({tokens('sentence')}) OVER best AS used
  FROM {to}_scored JOIN {to}_rows USING (id, ord) WINDOW best AS (PARTITION BY id ORDER BY score DESC, ord)),
{to}_size AS (SELECT id, least(400, ceil(sum({tokens('sentence')}) * 0.5)) AS budget FROM {to}_rows GROUP BY id),
{to}_best AS (SELECT id, string_agg(sentence, ' ' ORDER BY ord) AS summary FROM {to}_ranked JOIN {to}_size USING (id) WHERE rank = 1 OR used <= budget GROUP BY id),
{to} AS MATERIALIZED (SELECT id, coalesce(summary, ' ') AS summary FROM {to}_size LEFT JOIN {to}_best USING (id))"""


def vectors(source: str, key: str, text: str, dim: int = DIM, limit: int | None = None) -> str:
    """(key, vector) of every row of ``source``: mean of signed buckets over the terms."""
    lst = words(text) if limit is None else f"list_slice({words(text)}, 1, {limit})"
    return f"""SELECT {key}, list(coalesce(total, 0) / greatest(n_terms, 1) ORDER BY d) AS vector FROM (
  SELECT {key}, n_terms, d FROM (SELECT {key}, len({lst}) AS n_terms FROM {source}), (SELECT unnest(range(0, {dim})) AS d))
LEFT JOIN (SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % {dim} AS d, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS total
  FROM (SELECT {key}, md5(term) AS h FROM (SELECT {key}, unnest({lst}) AS term FROM {source})) GROUP BY ALL) USING ({key}, d)
GROUP BY {key}"""


def components(source: str, keys: str) -> str:
    """One row per vector component, rounded; vectors are stored as floats."""
    return (
        f"SELECT {keys}, pos, round(value, 6) + 0 AS value FROM (SELECT {keys}, unnest(range(0, len(vector))) AS pos, "
        f"unnest(vector) AS value FROM {source})"
    )


FLOATS = "list_transform(vector, lambda v: v::FLOAT::DOUBLE) AS vector"


def top(queries: str, rows: str, join: str = "true", keys: str = "", k: int = 10) -> str:
    """Ranked cosine hits of every query; q(qid, vector), v(id, vector)."""
    part = f"{keys}, qid" if keys else "qid"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC NULLS LAST, id) AS rank FROM (
  SELECT {'q.' + keys + ',' if keys else ''} q.qid, v.id,
    CASE WHEN q.norm > 0 AND v.norm > 0 THEN round(list_dot_product(q.vector, v.vector) / (q.norm * v.norm), 9) + 0 END AS score
  FROM (SELECT *, sqrt(list_dot_product(vector, vector)) AS norm FROM ({queries})) q
  JOIN (SELECT *, sqrt(list_dot_product(vector, vector)) AS norm FROM ({rows})) v ON {join})) WHERE rank <= {k}"""


DOUBLES = "embedding::DOUBLE[] AS vector"
SELF_Q = f"SELECT vec_id AS qid, label, {DOUBLES} FROM embeddings"
SELF_V = f"SELECT vec_id AS id, label, {DOUBLES} FROM embeddings"

# the authority, params and slashes of a URL, as in the canonical form
def canonical(x: str) -> str:
    scheme = f"lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*'))"
    rest = f"regexp_extract({x}, '^[^:/?#]+://([^?#]*)', 1)"
    host = f"replace(regexp_extract({rest}, '^[^/]*'), 'www.', '')"
    path = f"regexp_extract({rest}, '/.*$')"
    path = f"regexp_replace({path}, '^(.*/[^/;]*);[^/]*$', '\\1')"
    return f"(CASE {scheme} WHEN 'http' THEN 'https' ELSE {scheme} END || '://' || {host} || CASE {path} WHEN '/' THEN '/' ELSE rtrim({path}, '/') END)"


BLOCKS = (
    "address|article|aside|blockquote|body|br|caption|dd|details|div|dl|dt|fieldset|figcaption|"
    "figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|summary|table|"
    "tbody|td|tfoot|th|thead|tr|ul"
)
UNSEEN = [r"(?s)<!--.*?(?:-->|\z)", r"(?is)<script\b[^<>]*>.*?(?:</script\s*>|\z)", r"(?is)<style\b[^<>]*>.*?(?:</style\s*>|\z)"]


def visible(x: str) -> str:
    for pattern in UNSEEN:
        x = replaced(x, pattern, "")
    return x


def html_text(x: str) -> str:
    x = replaced(visible(x), r"(?is)<head\b[^<>]*>.*?</head\s*>", "")
    x = replaced(x, r"\s+", " ")
    x = f"regexp_replace({x}, '(?i)</?(?:{BLOCKS})\\b[^<>]*>', chr(10), 'g')"
    x = replaced(x, r"<[a-zA-Z/!?][^<>]*>", "")
    for name, char in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        x = f"replace({x}, '&{name};', '{char}')"
    x = f"regexp_replace({x}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return replaced(x, r"^[ \n]+|[ \n]+$", "")


def hrefs(x: str) -> str:
    return f"list_transform(regexp_extract_all({visible(x)}, '<a\\s[^<>]*href=\"([^\"]*)\"', 1), lambda h: replace(h, '&amp;', '&'))"


MARKED = (
    "text || printf(' Read http://host%d.example.org/a?b=%d now ,or mail user%d@example.org [1] [2-4, 7]. "
    "We took %d.25mg and %d.5e-4 of it [J]. Smith J. Doe 2019 pages %d.\nEnd é  by J. D. Roe !', "
    "doc_id, doc_id, doc_id, doc_id, doc_id, doc_id)"
)

FAN = 3
# tree(page_id, path): each page of the derived site and each missing page it links to (…/Other under negative ids)
TREE = f"""ids AS (SELECT DISTINCT unnest([page_id, page_id * {FAN} + 1, page_id * {FAN} + 2, page_id * {FAN} + 3, (page_id * {FAN} + 1) * {FAN} + 1]) AS page_id FROM pages
  UNION SELECT doc_id FROM documents),
climb AS (SELECT page_id, page_id AS node, '/Model' || page_id AS path FROM ids
  UNION ALL SELECT page_id, (node - 1) // {FAN}, '/Model' || ((node - 1) // {FAN}) || path FROM climb WHERE node > 0),
tree AS (SELECT page_id, path FROM climb WHERE node = 0 UNION ALL SELECT -1 - page_id, path || '/Other' FROM climb WHERE node = 0)"""

SITE = "'https://site.example.org'"
# links(src, pos, dst): the followed links between tree pages; offset by the anchors a page has of its own
LINKS = f"""own AS (SELECT page_id AS src, len({hrefs('html')}) AS n FROM pages),
links AS (SELECT src, n + place AS pos, dst FROM (
  SELECT src, n, unnest([0, 1, 2, 3, 5]) AS place,
    unnest([(src * {FAN} + 1) * {FAN} + 1, src * {FAN} + 1, src * {FAN} + 2, src * {FAN} + 3, -1 - src]) AS dst FROM own))"""
REACH = f"""{TREE}, {LINKS},
steps AS (SELECT page_id AS seed, page_id AS node, []::BIGINT[] AS route FROM pages
  UNION ALL SELECT seed, dst, list_append(route, pos) FROM steps JOIN links ON src = node),
reach AS (SELECT seed, node, min(route) AS route FROM steps GROUP BY ALL)"""


def tree_page(own: str = "tree") -> str:
    return f"""(SELECT page_id, 'http://www.site.example.org' || path || '/?from=feed' AS url, html || '<a href="' || path || '/Model' || ({FAN}*page_id+1) || '/Model' || ({FAN}*({FAN}*page_id+1)+1) || '">next</a> '
  || '<a href="' || path || '/Model' || ({FAN}*page_id+1) || '/">next</a> '
  || '<a href="Model' || page_id || '/./Model' || ({FAN}*page_id+2) || '?x=1#top">next</a> '
  || '<a href="HTTP://www.site.example.org' || path || '/Model' || ({FAN}*page_id+3) || '">next</a> '
  || '<a href="' || regexp_replace(path, '/[^/]*$', '') || '">next</a> '
  || '<a href="' || path || '/Other">next</a> '
  || '<a href="//elsewhere.example.org' || path || '/Model' || ({FAN}*page_id+1) || '">next</a> '
  || '<a href="/Elsewhere' || path || '/Model' || ({FAN}*page_id+1) || '">next</a> ' AS html
  FROM pages JOIN {own} USING (page_id))"""


# link(page_id, pos, href, src, link): all links of the derived site, resolved by the kinds that occur there
TREE_LINKS = f"""{TREE},
found AS ({exploded(tree_page(), 'page_id, url', hrefs('html'), 'href')}),
link AS (SELECT page_id, pos, href, src, CASE
    WHEN href = '' THEN src
    WHEN href LIKE 'HTTP://%' THEN href
    WHEN href LIKE '//%' THEN 'https:' || href
    WHEN href LIKE '/%' THEN {SITE} || href
    ELSE regexp_replace(src, '/[^/]*$', '/') || replace(href, '/./', '/') END AS link
  FROM (SELECT page_id, pos, href, {canonical('url')} AS src FROM found))"""

SITE_SENT = f"""{REACH},
text AS (SELECT page_id, {split(html_text('html'))} AS parts FROM {tree_page()}),
rows AS (SELECT seed, node, route, unnest(range(0, len(parts))) AS pos, unnest(parts) AS sentence FROM reach JOIN text ON node = page_id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, sentence ORDER BY route, pos) AS copy FROM rows) WHERE copy = 1)"""
SITE_TEXT = f"{SITE_SENT}, site AS (SELECT seed, {clean('txt')} AS text FROM (SELECT seed, string_agg(sentence, ' ' ORDER BY route, pos) AS txt FROM kept GROUP BY seed))"

PROJECT = f"""project AS (SELECT doc_id, (2017 + doc_id % 4)::INT AS Year, 'Team ' || doc_id AS Team_Name,
  'http://www.site.example.org' || path || '/?from=feed' AS Wiki, lang AS Region, source AS Location,
  'Institute of ' || source AS Institution, CASE WHEN doc_id % 2 = 0 THEN 'Undergrad' ELSE 'Overgrad' END AS Section,
  substr(text, 1, 20) AS Project_Title, upper(lang) AS Track, text AS Abstract, n_chars::VARCHAR AS Parts,
  CASE doc_id % 3 WHEN 0 THEN 'Gold' WHEN 1 THEN 'Silver' END AS Medal, 'none' AS Nominations, 'Award ' || (doc_id % 7) AS Awards
  FROM documents JOIN tree ON page_id = doc_id)"""
PROJECT_COLUMNS = ", ".join(METADATA_FIELDS)

RUN = """run AS (SELECT 'question ' || event_id AS question, props, [200, 300, 500, 800][(user_id % 4 + 1)::INT] AS chunk_size,
  'hub/' || event_type AS embedding_model, (floor(value)::BIGINT % 6)::INT AS eval_score FROM events)"""
NORMAL = "(nullif(eval_score, 0) - 1) / 4.0"

QUESTION = "(SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user')"

DOC_CHUNKS = f"{SENT}, {chunked(200)}"
CHUNK_VECS = f"cvec AS ({vectors('(SELECT *, ' + POINT_ID + ' AS id FROM chunk)', 'id', 'content')})"
HITS = f"""{DOC_CHUNKS}, {CHUNK_VECS}, qvec AS ({vectors(QUESTION, 'qid', 'question', limit=None)}),
hit AS ({top('SELECT qid, list_transform(vector, lambda x: x::FLOAT::DOUBLE) AS vector FROM qvec', 'SELECT id, list_transform(vector, lambda x: x::FLOAT::DOUBLE) AS vector FROM cvec')})"""

BLOCK_ORDER = ["Year", "Team_Name", "Project_Title", "Wiki", "Region", "Location", "Institution", "Section",
               "Track", "Abstract", "Parts", "Medal", "Nominations", "Awards"]
BLOCK = "'Wiki_content: ' || content || chr(10) || " + " || ".join(
    f"'{f}: ' || coalesce({f}::VARCHAR, '') || chr(10)" for f in BLOCK_ORDER
)
# block(qid, rank, Team_Name, block): every hit as labelled lines
HIT_BLOCKS = f"""{HITS}, {TREE}, {PROJECT},
block AS (SELECT qid, rank, Team_Name, {BLOCK} AS block FROM hit JOIN (SELECT *, {POINT_ID} AS id FROM chunk) USING (id) JOIN project USING (doc_id))"""

COMPLETION = """(SELECT conv_id, turn, CASE turn % 5
  WHEN 0 THEN 'Question: ' || text || chr(10) || 'Answer: ' || reverse(text) || ' ' || chr(10)
  WHEN 1 THEN 'Score: ' || (length(text) % 6) || ' as asked'
  WHEN 2 THEN 'Score: 4/5 ' || text
  WHEN 3 THEN text || ' Score:' || chr(10) || '3. Score: 2'
  ELSE text END AS completion FROM conversations)"""
FIRST_WORD = strip("split_part(completion, 'Score:', 2)")
SCORE = f"""CASE WHEN instr(completion, 'Score:') = 0 THEN 0 ELSE try_cast(
  CASE WHEN regexp_full_match(string_split_regex({FIRST_WORD}, '{BLANK}+')[1], '[+-]?[0-9]+') THEN string_split_regex({FIRST_WORD}, '{BLANK}+')[1] END AS INT) END"""

# evaluation chunks of the cleaned abstracts, for all sizes, with repeated sentences kept, summarised
EVAL_SENT = f"esent AS MATERIALIZED ({exploded('documents', 'doc_id', split(clean('text')))})"


def eval_chunks(size: int) -> str:
    """Tables of one size, named after it."""
    part = packed(size, keys="doc_id", counted=f"SELECT doc_id, pos, sentence, {tokens('sentence')} AS n FROM esent")
    part = part.replace("counted", f"counted{size}").replace("walk", f"walk{size}")
    return f"""{part}, chunk{size} AS (SELECT {size} AS chunk_size, doc_id, chunk_no, count(*) AS n_sentences, list(sentence ORDER BY pos) AS sentences
  FROM walk{size} JOIN counted{size} USING (doc_id, pos) GROUP BY doc_id, chunk_no)"""


SIZES = [200, 300, 500, 800]
GRID_MODELS = [("sentence-transformers/all-MiniLM-L6-v2", 64), ("sentence-transformers/all-mpnet-base-v2", 32), ("thenlper/gte-small", 16)]
MODELS = "(SELECT unnest([" + ", ".join(text_literal(n) for n, _ in GRID_MODELS) + "]) AS model)"
EVAL_CHUNKS = f"""{EVAL_SENT}, {', '.join(map(eval_chunks, SIZES))},
whole AS (SELECT chunk_size || '|' || {POINT_ID} AS id, * FROM ({' UNION ALL '.join(f'SELECT * FROM chunk{n}' for n in SIZES)})),
{summarised('whole', 'esum')}, echunk AS MATERIALIZED (SELECT chunk_size, doc_id, chunk_no, summary AS content FROM whole JOIN esum USING (id))"""
EVAL_KEY = """'{"id":{"doc_id":' || doc_id || ',"chunk_no":' || chunk_no || '}}'"""
# example(chunk_size, doc_id, chunk_no, content, question, answer): thirty per size, failed completions left out
EXAMPLES = f"""{EVAL_CHUNKS},
example AS (SELECT chunk_size, doc_id, chunk_no, content, 'what of ' || split_part(content, ' ', 1) || '?' AS question, {strip('substr(content, 1, 40)')} AS answer
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_size ORDER BY md5('5:' || {EVAL_KEY}), {EVAL_KEY}) AS place FROM echunk)
  WHERE place <= 30 AND length(content) % 5 <> 0)"""


FRESH = "fresh AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_size, question ORDER BY doc_id, chunk_no) AS copy FROM example) WHERE copy = 1)"


def grid_hits() -> str:
    parts = []
    for name, dim in GRID_MODELS:
        key = "cid"
        source = f"(SELECT chunk_size || '|' || {POINT_ID} AS cid, content FROM echunk)"
        asked = "(SELECT chunk_size || '|' || question AS cid, question FROM fresh)"
        cast = "list_transform(vector, lambda x: x::FLOAT::DOUBLE) AS vector"
        queries = f"SELECT split_part(cid, '|', 1) AS chunk_size, substr(cid, 5) AS qid, {cast} FROM ({vectors(asked, key, 'question', dim)})"
        rows = f"SELECT split_part(cid, '|', 1) AS chunk_size, substr(cid, 5)::BIGINT AS id, {cast} FROM ({vectors(source, key, 'content', dim)})"
        parts.append(f"SELECT '{name}' AS embedding_model, * FROM ({top(queries, rows, 'q.chunk_size = v.chunk_size', 'chunk_size')})")
    return f"""{EXAMPLES}, {FRESH},
ghit AS ({' UNION ALL '.join(parts)})"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_text"] = f"SELECT doc_id, {clean(MARKED)} AS cleaned FROM documents"
    q["cleaning_steps"] = " UNION ALL ".join(
        f"SELECT doc_id, {i}::INT AS step, md5({clean(MARKED, i + 1) if i < 10 else replaced(clean(MARKED, 10), *CLEANING[10])}) AS digest FROM documents"
        for i in range(len(CLEANING))
    )
    q["sentences"] = exploded("documents", "doc_id", split("text"))
    q["token_counts"] = f"SELECT doc_id, count(*) AS n_sentences, sum({tokens('sentence')})::BIGINT AS n_tokens FROM ({q['sentences']}) GROUP BY doc_id"
    q["stripped_text"] = f"""SELECT conv_id, turn, {strip("' ' || chr(9) || chr(10) || text || chr(13) || chr(10) || '  '")} AS stripped FROM conversations"""
    q["canonical_urls"] = f"SELECT page_id, {canonical('url')} AS canonical FROM pages"
    q["html_text"] = f"SELECT page_id, {html_text('html')} AS text FROM pages"
    q["anchors"] = exploded("pages", "page_id", hrefs("html"), "href")
    q["resolved_links"] = f"WITH RECURSIVE {TREE_LINKS} SELECT page_id, pos, link FROM link"
    q["link_predicates"] = f"""WITH RECURSIVE {TREE_LINKS} SELECT src AS src_url, pos, dst AS dst_url,
  regexp_matches(dst, 'Overview|Description|Model|Modelling|Experiments|Engineering|Results|Design|Implementation') AS has_keyword,
  split_part(src, '/', 3) = split_part(dst, '/', 3) AS is_same_host,
  starts_with(regexp_extract(dst, '//[^/]*(.*)$', 1), regexp_extract(src, '//[^/]*(.*)$', 1)) AS is_below
  FROM (SELECT src, pos, {canonical('link')} AS dst FROM link)"""

    q["project_csv"] = f"WITH RECURSIVE {TREE}, {PROJECT} SELECT {PROJECT_COLUMNS} FROM project WHERE Year = 2019"
    q["stage_table"] = f"SELECT doc_id, length({clean('text')}) AS n_chars FROM documents"
    q["fetched_pages"] = f"""WITH k AS (SELECT page_id, html, {canonical('url')} AS page_url FROM pages)
SELECT w.page_id AS want_id, w.page_url, p.page_id, length(p.html) AS n_chars FROM k w JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY page_id) AS copy FROM k) WHERE copy = 1) p USING (page_url)"""
    q["result_files"] = f"WITH {RUN} SELECT question, eval_score, chunk_size::VARCHAR AS chunk_size, embedding_model FROM run"
    q["result_arrays"] = f"WITH {RUN} SELECT question, eval_score, chunk_size::VARCHAR AS chunk_size FROM run"
    q["result_array_ranges"] = q["result_arrays"]
    q["result_partitions"] = f"""WITH {RUN} SELECT chunk_size || ',' || replace(embedding_model, '/', '-') AS settings, count(*) AS n,
  sum(eval_score + CASE WHEN chunk_size = 300 AND embedding_model = 'hub/click' THEN 10 ELSE 0 END)::BIGINT AS total FROM run GROUP BY ALL"""
    q["concatenated_results"] = f"WITH {RUN} SELECT question, chunk_size, embedding_model, nullif(eval_score, 0) AS eval_score FROM run"
    q["collection_upsert"] = f"""WITH RECURSIVE {DOC_CHUNKS} SELECT {POINT_ID} AS id,
  CASE chunk_no WHEN 0 THEN 'changed' ELSE content END AS "Wiki_content", lang, 64 AS dim FROM chunk JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)"""
    q["collection_replace"] = f"""WITH RECURSIVE {DOC_CHUNKS} SELECT {POINT_ID} AS id, content AS "Wiki_content", lang, 64 AS dim
  FROM chunk JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE lang = 'en'"""
    q["collection_counts"] = f"WITH RECURSIVE {DOC_CHUNKS} SELECT count(*) AS n_points, false AS was_populated, true AS is_populated FROM chunk"

    q["first_sentences"] = f"""SELECT lang, sentence, doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY lang, sentence ORDER BY doc_id, pos) AS copy
  FROM ({exploded('documents', 'lang, doc_id', split('text'))})) WHERE copy = 1"""
    q["joined_conversations"] = "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
    q["chunks"] = f"WITH RECURSIVE {DOC_CHUNKS} SELECT doc_id, chunk_no, n_sentences, n_tokens, content FROM chunk"
    q["chunk_numbers"] = f"""WITH RECURSIVE raw AS ({q['sentences']}), {packed(200, 'raw')} SELECT doc_id, pos, n, chunk_no FROM walk"""
    q["sql_clean_text"], q["sql_chunk_numbers"] = q["clean_text"], q["chunk_numbers"]
    q["chunk_summaries"] = f"WITH RECURSIVE {DOC_CHUNKS}, {summarised(f'(SELECT {POINT_ID} AS id, * FROM chunk)')} SELECT id, summary FROM summed"
    q["pooled_vectors"] = f"""SELECT label, d AS pos, round(total / greatest(weight, 1e-9), 6) + 0 AS value FROM (
  SELECT label, d, sum(x::DOUBLE * mask) AS total, sum(mask) AS weight FROM (
    SELECT label, (vec_id % 3 <> 0)::INT AS mask, unnest(range(0, {DIM})) AS d, unnest(embedding) AS x FROM embeddings) GROUP BY ALL)"""
    q["chunk_embeddings"] = f"WITH RECURSIVE {DOC_CHUNKS}, {CHUNK_VECS} {components(f'(SELECT id, {FLOATS} FROM cvec)', 'id')}"
    q["question_embeddings"] = components(f"(SELECT qid, {FLOATS} FROM ({vectors(QUESTION, 'qid', 'question', limit=20)}))", "qid")
    letters = ", ".join(f"((length(text) - length(replace(text, '{c}', ''))) / greatest(length(text), 1))::FLOAT::DOUBLE" for c in "abcdefgh")
    q["encoded_points"] = components(f"(SELECT conv_id * 1000 + turn AS id, [{letters}] AS vector FROM conversations)", "id")
    q["unit_vectors"] = components(
        f"(SELECT vec_id AS id, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS vector FROM (SELECT vec_id, {DOUBLES} FROM embeddings))",
        "id",
    )
    q["dense_ids"] = f"WITH RECURSIVE {DOC_CHUNKS} SELECT row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS id, doc_id, chunk_no FROM chunk"
    q["payloads"] = f"""WITH RECURSIVE {TREE}, {PROJECT} SELECT doc_id, Abstract AS "Wiki_content", {PROJECT_COLUMNS} FROM project"""

    plain = "SELECT qid, id, score, rank FROM"
    q["nearest_neighbours"] = f"{plain} ({top(SELF_Q, SELF_V)})"
    q["nearest_by_blocks"] = q["nearest_neighbours"]
    q["cell_search_exact"] = q["nearest_neighbours"]
    q["cell_search_recall"] = f"SELECT count(*) AS n_true, true AS is_complete, true AS finds_most, true AS skips_much FROM ({q['nearest_neighbours']})"
    q["quantised_recall"] = f"SELECT n_cells, count(*) AS n_true, true AS is_complete, true AS finds_most, true AS scores_few, 32::BIGINT AS code_bytes FROM ({q['nearest_neighbours']}), (VALUES (16), (256)) AS c(n_cells) GROUP BY n_cells"
    q["quantised_first_hits"] = f"SELECT qid, id, score FROM ({q['nearest_neighbours']}) WHERE rank = 1"
    q["nearest_by_label"] = f"SELECT label, qid, id, score, rank FROM ({top(SELF_Q, SELF_V, 'q.label = v.label', 'label')})"
    q["filtered_search"] = f"{plain} ({top(SELF_Q, SELF_V + ' WHERE label IN (1, 3, 5)')})"
    q["hits_with_payload"] = f"SELECT qid, rank, id, lang, length(text) AS n_chars FROM ({top(SELF_Q, SELF_V)}) JOIN documents ON doc_id = id"
    q["payload_lookup"] = q["hits_with_payload"]

    q["parsed_completions"] = f"""SELECT conv_id, turn,
  {strip("split_part(split_part(completion, 'Question: ', -1), 'Answer: ', 1)")} AS question,
  {strip("split_part(completion, 'Answer: ', -1)")} AS answer, {SCORE} AS score FROM {COMPLETION}"""
    q["settings_strings"] = f"""WITH {RUN}, c AS (SELECT DISTINCT chunk_size, embedding_model, replace(embedding_model, '/', '-') AS m FROM run)
SELECT 'chunk_size:' || chunk_size || '_embeddings:' || m AS name, 'rag_chunk_size:' || chunk_size || '_embeddings:' || m || '.json' AS file,
  'RAGConfig(dataset=data/table.parquet, chunk_size=' || chunk_size || ', embedding_model_name=' || embedding_model AS config,
  chunk_size || ',' || m AS short, 'data/table.parquet' AS dataset, chunk_size, embedding_model AS embedding_model_name FROM c"""
    q["question_hits"] = f"WITH RECURSIVE {HITS} SELECT qid, id, score, rank FROM hit"
    q["hit_blocks"] = f"WITH RECURSIVE {HIT_BLOCKS} SELECT qid, rank, block FROM block"
    context = "'Retrieved projects:' || chr(10) || string_agg(block, '' ORDER BY rank)"
    q["answer_prompts"] = f"""WITH RECURSIVE {HIT_BLOCKS} SELECT qid, 2 AS n_messages, {text_literal(ANSWER_ROLE)} AS first,
  md5('Context:' || chr(10) || {context} || chr(10) || '---' || chr(10) || 'Question, to be answered from the context above:' || chr(10) || any_value(question)) AS last_digest
  FROM block JOIN {QUESTION} USING (qid) GROUP BY qid"""
    q["fallback_prompts"] = f"""SELECT qid, 1 AS n_messages, 'user' AS role,
  'Question: ' || question || chr(10) || 'No relevant project information was found.' AS content FROM {QUESTION}"""
    q["batch_answers"] = f"""WITH RECURSIVE {HIT_BLOCKS}, known AS (SELECT DISTINCT question FROM {QUESTION} WHERE qid % 7 <> 0)
SELECT qid, any_value(question) AS question, any_value(CASE WHEN question IN (SELECT question FROM known) THEN 'On: ' || question END) AS answer,
  string_agg(Team_Name, ',' ORDER BY rank) AS teams FROM block JOIN {QUESTION} USING (qid) GROUP BY qid"""

    q["reached_pages"] = f"""WITH RECURSIVE {REACH} SELECT seed, {SITE} || path AS page_url, array_to_string(route, '/') AS route FROM reach JOIN tree ON page_id = node"""
    q["site_texts"] = f"WITH RECURSIVE {SITE_TEXT} SELECT seed, text FROM site"
    page = f"""ptext AS (SELECT seed, node, string_agg(sentence, ' ' ORDER BY pos) AS txt FROM kept GROUP BY ALL),
psent AS ({exploded('ptext', 'seed, node', split(clean('txt')))})"""
    q["page_sources"] = f"""WITH RECURSIVE {SITE_SENT}, {page}, {packed(200, 'psent', 'seed, node')}
SELECT seed, {SITE} || path AS page_url, chunk_no, count(*) AS n_sentences, sum(n)::BIGINT AS n_tokens FROM walk JOIN tree ON page_id = node GROUP BY ALL"""
    q["prepared_projects"] = f"""WITH RECURSIVE {SITE_TEXT}, {PROJECT} SELECT doc_id, Year, Wiki, {clean('Abstract')} AS "Abstract", coalesce(site.text, '') AS "Wiki_content"
  FROM project LEFT JOIN site ON seed = doc_id WHERE Year = 2019"""

    q["sampled_chunks"] = f"""WITH RECURSIVE {DOC_CHUNKS}, c AS (SELECT lang, {POINT_ID} AS id, n_tokens FROM chunk JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))
SELECT lang, id, n_tokens FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || id), id) AS place FROM c) WHERE place <= 30"""
    q["sampled_documents"] = "SELECT doc_id, lang FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 30"
    q["evaluation_chunk_counts"] = f"""WITH RECURSIVE {EVAL_CHUNKS}, {RUN} SELECT chunk_size, n_chunks, models FROM
  (SELECT chunk_size, count(*) AS n_chunks FROM echunk GROUP BY ALL) JOIN
  (SELECT chunk_size, string_agg(DISTINCT embedding_model, ',' ORDER BY embedding_model) AS models FROM run GROUP BY ALL) USING (chunk_size)"""
    q["question_answer_pairs"] = f"""WITH RECURSIVE {EXAMPLES} SELECT chunk_size, doc_id, chunk_no, content AS qa_context, question,
  answer AS reference_answer, 'Team ' || doc_id AS "Team_Name" FROM example"""
    q["pending_questions"] = f"""WITH {RUN} SELECT chunk_size, props AS question, min(embedding_model) AS embedding_model FROM run
  WHERE (chunk_size, props) NOT IN (SELECT (chunk_size, props) FROM run WHERE eval_score = 5) GROUP BY ALL"""
    q["grid_run"] = f"""WITH RECURSIVE {grid_hits()} SELECT f.chunk_size, g.embedding_model, f.question,
  'RAGConfig(dataset=data/table, chunk_size=' || f.chunk_size || ', embedding_model_name=' || g.embedding_model AS test_settings,
  CASE WHEN length(f.question) % 7 <> 0 THEN 'On: ' || f.question END AS answer,
  string_agg('Team ' || (g.id // 16777216), ',' ORDER BY g.rank) AS teams
  FROM fresh f JOIN ghit g ON f.chunk_size::VARCHAR = g.chunk_size AND f.question = g.qid GROUP BY ALL"""
    q["retrieval_quality"] = f"""WITH RECURSIVE {grid_hits()}, place AS (SELECT f.chunk_size, g.embedding_model, f.question,
    min(CASE WHEN c.content = f.content THEN g.rank END) AS place FROM fresh f JOIN ghit g ON f.chunk_size::VARCHAR = g.chunk_size AND f.question = g.qid
    JOIN (SELECT chunk_size, {POINT_ID} AS id, content FROM echunk) c ON c.chunk_size = f.chunk_size AND c.id = g.id GROUP BY ALL)
SELECT chunk_size, embedding_model, count(*) AS n_questions, round(avg((place IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr FROM place GROUP BY ALL"""
    q["judged_answers"] = f"""WITH c AS (SELECT c.conv_id, c.turn, completion, v.role, v.text FROM {COMPLETION} c JOIN conversations v USING (conv_id, turn)),
  g AS (SELECT role, text, min(completion) AS completion FROM c GROUP BY ALL)
SELECT conv_id, turn, {SCORE.replace('completion', 'g.completion')} AS eval_score FROM c JOIN g USING (role, text)"""
    q["judge_prompts"] = """SELECT conv_id, turn, 'Question: ' || role || chr(10) || 'Response: ' || text || chr(10) || 'Reference answer: none' || chr(10) AS content FROM conversations"""
    q["resumed_run"] = f"""WITH {RUN} SELECT chunk_size, props AS question, coalesce(min(eval_score) FILTER (eval_score > 2), min(eval_score)) AS eval_score FROM run GROUP BY ALL"""
    q["score_report"] = f"""WITH {RUN} SELECT chunk_size || ',' || replace(embedding_model, '/', '-') AS settings_name, round(avg({NORMAL}), 9) AS avg_score FROM run GROUP BY ALL"""
    q["term_pairs"] = f"""WITH RECURSIVE {DOC_CHUNKS},
  term AS MATERIALIZED (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS ord FROM (SELECT {POINT_ID} AS id, {words('content')} AS w FROM chunk)),
  known AS (SELECT term FROM term GROUP BY term HAVING count(*) >= 3)
SELECT least(a.term, b.term) AS first, greatest(a.term, b.term) AS second, count(*) AS n FROM term a JOIN term b ON a.id = b.id AND b.ord - a.ord BETWEEN 1 AND 4
  WHERE a.term IN (SELECT term FROM known) AND b.term IN (SELECT term FROM known) GROUP BY ALL"""
    q["learned_retrieval"] = f"WITH RECURSIVE {DOC_CHUNKS} SELECT count(*) AS n_questions, true AS finds_more FROM chunk WHERE chunk_no = 0"
    draw = "('0x' || substr(sha256('0#' || (r // 8) || '#' || unit), 8 * (r % 8) + 1, 8))::BIGINT"
    weight = " + ".join(f"({draw} >= {step})::INT" for step in POISSON_STEPS)
    q["score_intervals"] = f"""WITH {RUN}, graded AS (SELECT 'out/rag_chunk_size:' || chunk_size || '_embeddings:' || replace(embedding_model, '/', '-') || '.json' AS settings,
    split_part(question, ' ', 2)::BIGINT // 20 AS unit, {NORMAL} AS score FROM run),
  weight AS MATERIALIZED (SELECT unit, r, {weight} AS w FROM (SELECT DISTINCT unit FROM graded WHERE score IS NOT NULL), range(200) t(r)),
  mean AS (SELECT settings, r, sum(w * score) / sum(w) AS m FROM graded JOIN weight USING (unit) WHERE score IS NOT NULL AND w > 0 GROUP BY ALL),
  won AS (SELECT settings, count(*) AS n FROM (SELECT settings, row_number() OVER (PARTITION BY r ORDER BY round(m, 12) DESC, settings) AS place FROM mean) WHERE place = 1 GROUP BY ALL),
  bound AS (SELECT settings, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM mean GROUP BY ALL)
SELECT settings, count(score) AS n_scored, round(avg(score), 9) AS avg_score, round(any_value(low), 9) AS low, round(any_value(high), 9) AS high,
  round(coalesce(any_value(n), 0) / 200, 9) AS win_share FROM graded LEFT JOIN bound USING (settings) LEFT JOIN won USING (settings) GROUP BY ALL"""
    best = f"""SELECT 'data/table' AS dataset, chunk_size, embedding_model AS embedding_model_name, round(avg({NORMAL}), 9) AS best_score
  FROM run GROUP BY chunk_size, embedding_model ORDER BY avg({NORMAL}) DESC NULLS LAST, 'out/rag_chunk_size:' || chunk_size || '_embeddings:' || replace(embedding_model, '/', '-') LIMIT 1"""
    q["best_configuration"] = f"WITH {RUN} {best}"
    q["chosen_configuration"] = f"""WITH {RUN} SELECT chunk_size, embedding_model_name, false AS is_default FROM ({best})
UNION ALL SELECT {DEFAULT_CHUNK_SIZE}, '{DEFAULT_MODEL}', true"""

    q["stream_ingest"] = f"""WITH RECURSIVE {DOC_CHUNKS} SELECT {POINT_ID} AS id, content AS "Wiki_content", 64 AS dim FROM chunk"""
    q["stream_questions"] = "SELECT DISTINCT props AS question FROM events"
    q["stream_first_questions"] = q["stream_questions"]
    q["stream_search"] = f"WITH RECURSIVE {HITS} SELECT qid, rank, id, score FROM hit"

    made = f"{EVAL_SENT}, sent AS (SELECT * FROM esent), {chunked(250)}, {summarised(f'(SELECT {POINT_ID} AS id, * FROM chunk)')}"
    q["built_index"] = f"""WITH RECURSIVE {made}, svec AS ({vectors('summed', 'id', 'summary')})
{components(f'''(SELECT id, summary AS "Wiki_content", 'Team ' || (id // 16777216) AS "Team_Name", {FLOATS} FROM summed JOIN svec USING (id))''', 'id, "Wiki_content", "Team_Name"')}"""
    psent = f"psent AS ({exploded('(SELECT doc_id, site.text AS text FROM documents JOIN site ON seed = doc_id WHERE doc_id % 4 = 2)', 'doc_id', split('text'))})"
    vector = "list_transform(vector, lambda x: x::FLOAT::DOUBLE) AS vector"
    q["production_run"] = f"""WITH RECURSIVE {SITE_TEXT}, {psent}, sent AS (SELECT * FROM psent), {chunked(250)},
{summarised(f'(SELECT {POINT_ID} AS id, * FROM chunk)')}, pvec AS ({vectors('summed', 'id', 'summary')}), qvec AS ({vectors(QUESTION, 'qid', 'question')}),
hit AS ({top(f'SELECT qid, {vector} FROM qvec', f'SELECT id, {vector} FROM pvec')}), known AS (SELECT DISTINCT question FROM {QUESTION} WHERE qid % 7 <> 0)
SELECT qid, any_value(CASE WHEN question IN (SELECT question FROM known) THEN 'On: ' || question END) AS answer,
  string_agg('Team ' || (id // 16777216), ',' ORDER BY rank) AS teams, md5(string_agg(summary, '|' ORDER BY rank)) AS contents
  FROM hit JOIN summed USING (id) JOIN {QUESTION} USING (qid) GROUP BY qid"""
    ssent = f"""csent AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY route, pos) - 1 AS pos, sentence FROM (
  SELECT seed, route, pos, {clean('sentence')} AS sentence FROM kept) WHERE sentence <> '')"""
    q["site_chunks"] = f"""WITH RECURSIVE {SITE_SENT}, {ssent}, {packed(200, 'csent', 'seed')}
SELECT seed, chunk_no, count(*) AS n_sentences, sum(w.n)::BIGINT AS n_tokens, string_agg(sentence, ' ' ORDER BY pos) AS content
  FROM walk w JOIN counted USING (seed, pos) GROUP BY seed, chunk_no"""
    graded = f"(SELECT f.chunk_size, m.model AS embedding_model, nullif(length(f.question) % 6, 0) AS score FROM fresh f, {MODELS} m)"
    q["evaluation_scores"] = f"""WITH RECURSIVE {EXAMPLES}, {FRESH} SELECT chunk_size || ',' || replace(embedding_model, '/', '-') AS settings_name,
  round(avg((score - 1) / 4.0), 9) AS avg_score FROM {graded} GROUP BY ALL"""
    q["evaluation_choice"] = f"""WITH RECURSIVE {EXAMPLES}, {FRESH} SELECT chunk_size, embedding_model AS embedding_model_name, false AS is_default FROM {graded}
  GROUP BY chunk_size, embedding_model ORDER BY avg((score - 1) / 4.0) DESC NULLS LAST, 'rag_chunk_size:' || chunk_size || '_embeddings:' || replace(embedding_model, '/', '-') LIMIT 1"""
    return q
