"""The queries of ``lodestone.plans.queries`` as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..functions.detect import EXTENSIONS, MIME_TYPES
from ..functions.text import STOPWORDS
from .queries import CHUNK, FRAME, NAMES, OVERLAP, QUERY_TEXT, QUERY_VECTOR, K
from .store_queries import DIM, RANGE

#: Unicode whitespace, spelled out for RE2.
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _pieces(text: str) -> str:
    return rf"list_transform(regexp_split_to_array({text}, '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: lower(w))"


def _terms(text: str) -> str:
    return f"list_filter({_pieces(text)}, lambda w: strlen(w) >= 3 and w not in ({_STOP}))"


def _query(text: str) -> str:
    return f"list_distinct(list_filter({_pieces(text)}, lambda w: strlen(w) >= 2))"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_WS}+'), lambda w: w <> '')"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


_EXT = "[" + ", ".join(f"'{n}'" for n in NAMES) + f"][(doc_id % {len(NAMES)})::int + 1]"
_NAME = f"('d' || doc_id || case when {_EXT} = '' then '' else '.' || {_EXT} end)"


def _by_extension(table: dict[str, str], other: str) -> str:
    return "case " + " ".join("when {} in ({}) then '{}'".format(_EXT, ", ".join(f"'{n}'" for n in names.split()), value) for value, names in table.items()) + f" else {other} end"


_MODALITY = _by_extension(EXTENSIONS, "'text'")
_CODEC = "case modality when 'audio' then 'lzma(4)' when 'image' then 'zstd(9)' when 'video' then 'lz4' else 'lzma(6)' end"

_TOKENS = f"tok as (select doc_id, unnest(list_distinct({_terms('text')})) as token from documents)"
_LENGTHS = f"len as (select doc_id, len(list_distinct({_terms('text')})) as doc_len from documents)"
_ONE = f"q as (select 0 as qid, unnest({_query(repr(QUERY_TEXT))}) as token)"
_MANY = f"q as (select item_id as qid, unnest({_query('text')}) as token from benchmark)"


def _bm25(docs: str = "true", queries: str = _ONE) -> str:
    """CTEs up to scored(qid, doc_id, score), over the documents that ``docs`` keeps."""
    return f"""{_TOKENS}, {_LENGTHS}, {queries},
 stats as (select count(*) as n, avg(doc_len) as avg_len from len where {docs}),
 hit as (select doc_id, token, doc_len from tok join len using (doc_id) where token in (select token from q) and {docs}),
 freq as (select token, count(*) as df from hit group by token),
 scored as (select qid, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 9) as score
  from hit join freq using (token) cross join stats join q using (token) group by qid, doc_id)"""


def _ranked(scored: str, name: str, key: str, k: int) -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by qid order by score desc, {key}) as rank from {scored}) where rank <= {k})"


_COSINE = "case when list_dot_product(a.e, a.e) = 0 or list_dot_product(b.e, b.e) = 0 then 0.0 else list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) end"
_VECTORS = "vec as (select vec_id, embedding::double[] as e from embeddings)"


def _cosine(queries: str, docs: str = "true") -> str:
    """CTEs up to near(qid, doc_id, score): all vectors against those of ``queries`` (qid, e)."""
    return f"{_VECTORS}, b as ({queries}), near as (select qid, doc_id, round({_COSINE}, 6) + 0.0 as score from (select vec_id as doc_id, * from vec) a cross join b where {docs})"


_ONE_VECTOR = f"select 0 as qid, e from vec where vec_id = {QUERY_VECTOR}"
_OUT = "doc_id, score, rank"


def _hybrid(weight: float = 0.5, docs: str = "true", keep: str = "true", queries: str = _ONE, vectors: str = _ONE_VECTOR, out: str = _OUT, tail: str = "") -> str:
    return f"""with {_bm25(docs, queries)}, {_ranked('scored', 'text_arm', 'doc_id', 4 * K)},
 {_cosine(vectors, docs)}, {_ranked('near', 'vector_arm', 'doc_id', 4 * K)},
 fused as (select qid, doc_id, round(sum(part), 12) as score from (
   select qid, doc_id, {weight}::double / (60 + rank) as part from vector_arm union all
   select qid, doc_id, (1.0::double - {weight}::double) / (60 + rank) from text_arm) group by qid, doc_id),
 kept as (select * from fused where {keep}),
 {_ranked('kept', 'final', 'doc_id', K)}
select {out} from final {tail}"""


_TEXT = f"doc_id in (select doc_id from documents where {_MODALITY} = 'text')"
_ENGLISH = "doc_id in (select doc_id from documents where lang = 'en')"

_SENTENCES = f"list_filter(list_transform(regexp_extract_all(text, '[^.?!]*[.?!]|[^.?!]+$'), lambda s: {_trim('s')}), lambda s: s <> '')"

#: Sentences are packed one after another: a recursive query carries the words of the open chunk.
_CHUNKS = f"""with recursive sent as (select doc_id, text, {_SENTENCES} as s, len({_words('text')}) as total from documents),
 words as (select doc_id, text, total, s, list_transform(s, lambda x: len({_words('x')})) as w, flatten(list_transform(s, lambda x: {_words('x')})) as every from sent),
 fold as (select doc_id, s, w, every, 1 as i, 0 as held, 0 as seen, 0 as chunk_index, 1 as first, 0 as first_seen, 0 as over, null::varchar as chunk from words where total > {CHUNK}
  union all
  select doc_id, s, w, every, i + 1,
   case when full_ then least({OVERLAP}, held) + w[i] else held + coalesce(w[i], 0) end, seen + coalesce(w[i], 0),
   chunk_index + (full_ or i > len(s))::int, case when full_ then i else first end, case when full_ then seen else first_seen end,
   case when full_ then least({OVERLAP}, held) else over end,
   case when full_ or i > len(s) then case when chunk_index = 0 then '' else array_to_string(every[first_seen - over + 1 : first_seen], ' ') || ' ' end || array_to_string(s[first : i - 1], ' ') end
  from (select *, i <= len(s) and held + w[i] > {CHUNK} and i > 1 as full_ from fold) where i <= len(s) + 1),
 cut as (select doc_id, chunk_index - 1 as chunk_index, chunk from fold where chunk is not null
  union all select doc_id, 0, text from words where total <= {CHUNK})"""

#: The vector of a text by the hashes of its tokens, and searches by it.
_PLACES = f"list_transform(list_distinct({_terms('text')}), lambda t: (('0x' || substr(md5(t), 1, 8))::bigint % {DIM}))"
_HASHED = f"""(select key, list_transform(c, lambda x: (case when n > 0 then x / n else 0 end)::float::double) as e from (select key, c, sqrt(list_dot_product(c, c)) as n from (
   select key, list_transform(range({DIM}), lambda i: len(list_filter(p, lambda x: x = i))::double) as c from (select key, {_PLACES} as p from __rows__))))"""
_BY_TEXT = f"""with {_bm25('true', _MANY)}, {_ranked('scored', 'text_arm', 'doc_id::varchar', 4 * K)},
 near as (select b.key as qid, a.key as doc_id, round({_COSINE}, 6) + 0.0 as score from {_HASHED.replace('__rows__', '(select doc_id as key, text from documents)')} a cross join {_HASHED.replace('__rows__', '(select item_id as key, text from benchmark)')} b),
 {_ranked('near', 'vector_arm', 'doc_id::varchar', 4 * K)},
 fused as (select qid, doc_id, round(sum(part), 12) as score from (select qid, doc_id, 0.5::double / (60 + rank) as part from vector_arm union all select qid, doc_id, 0.5::double / (60 + rank) from text_arm) group by qid, doc_id),
 {_ranked('fused', 'final', 'doc_id::varchar', K)}
select qid, doc_id, score, rank from final"""

_LATER = "doc_id % 2 = 0 or doc_id % 4 <> 2"

SQL: dict[str, str] = {
    "tokenize_docs": f"with {_TOKENS} select doc_id, token from tok",
    "tokenize_query_terms": f"select item_id, unnest({_query('text')}) as token from benchmark",
    "term_frequency": f"select doc_id, token, count(*) as tf from (select doc_id, unnest({_terms('text')}) as token from documents) group by doc_id, token",
    "word_counts": f"select doc_id, len({_words('text')}) as n_words from documents",
    "strip_tags": f"select page_id, array_to_string({_words(chr(114) + 'egexp_replace(html, ' + repr('<[^>]*(>|$)|>') + ', ' + repr('') + ', ' + repr('g') + ')')}, ' ') as stripped from pages",
    "previews": f"""select doc_id, case when length(name) > 18 then name[1:16] || '..' else name end as filename, case when length(line) > 50 then line[1:47] || '...' else line end as summary
 from (select doc_id, 'a-rather-long-' || {_NAME} as name, replace(text, chr(10), ' ') as line from documents)""",
    "document_frequency": f"with {_TOKENS} select token, count(*) as df from tok group by token",
    "doc_lengths": f"with {_LENGTHS} select doc_id, doc_len from len",
    "corpus_stats": f"with {_LENGTHS} select count(*) as n, round(avg(doc_len), 6) as avg_len from len",
    "bm25_scores": f"with {_bm25()} select doc_id, score from scored",
    "bm25_topk": f"with {_bm25()}, {_ranked('scored', 'best', 'doc_id', K)} select {_OUT} from best",
    "bm25_tf_variant": f"""with flat as (select doc_id, unnest({_terms('text')}) as token from documents), tok as (select doc_id, token, count(*) as tf from flat group by doc_id, token),
 len as (select doc_id, len({_terms('text')}) as doc_len from documents), stats as (select count(*) as n, avg(doc_len) as avg_len from len), {_ONE},
 freq as (select token, count(*) as df from tok where token in (select token from q) group by token)
select doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 9) as score
from tok join freq using (token) join len using (doc_id) cross join stats group by doc_id""",
    "cosine_scores": f"with {_VECTORS}, b as ({_ONE_VECTOR}) select vec_id, round({_COSINE}, 6) as score from vec a cross join b",
    "cosine_topk": f"with {_cosine(_ONE_VECTOR)}, {_ranked('near', 'best', 'doc_id', K)} select doc_id as vec_id, score, rank from best",
    "cosine_zero_query": f"with {_cosine('select 0 as qid, list_transform(e, lambda x: x * 0) as e from vec where vec_id = ' + str(QUERY_VECTOR))}, {_ranked('near', 'best', 'doc_id', K)} select doc_id as vec_id, score, rank from best",
    "vector_batch": f"with {_cosine('select vec_id as qid, e from vec where vec_id % 50 = 0')}, {_ranked('near', 'best', 'doc_id', K)} select qid, doc_id as vec_id, score, rank from best",
    "hybrid_rrf": _hybrid(),
    "hybrid_pure_bm25": _hybrid(0.0),
    "hybrid_pure_vector": _hybrid(1.0),
    "hybrid_modality_filter": _hybrid(keep=_TEXT),
    "hybrid_metadata_filter": _hybrid(keep=_ENGLISH),
    "hybrid_filter_intersection": _hybrid(keep=f"{_TEXT} and {_ENGLISH}"),
    "hybrid_prefilter": _hybrid(docs=f"{_TEXT} and {_ENGLISH}"),
    "hybrid_enriched": _hybrid(out=f"doc_id, score, rank, {_NAME} as filename, {_MODALITY} as modality, lang, doc_id % 3 = 0 as has_payload", tail="join documents using (doc_id)"),
    "hybrid_batch": _hybrid(queries=_MANY, vectors="select item_id as qid, e from benchmark join vec on item_id = vec_id", out="qid, doc_id, score, rank"),
    "metadata_kv_search": "select doc_id from documents where source = 'src3'",
    "metadata_nonstring_no_match": "select event_id from events where json_type(props, '$.k') = 'VARCHAR' and json_extract_string(props, '$.k') = '1'",
    "detect_modality": f"select doc_id, {_NAME} as filename, {_by_extension(EXTENSIONS, chr(99) + 'ase doc_id % 3 when 0 then ' + repr('document') + ' when 1 then ' + repr('image') + ' else ' + repr('text') + ' end')} as modality from documents",
    "detect_mime": f"select doc_id, {_by_extension(MIME_TYPES, repr('application/octet-stream'))} as mime_type from documents",
    "should_chunk": f"select doc_id, len({_words('text')}) > {CHUNK} as chunked from documents",
    "sentences": f"select doc_id, pos - 1 as pos, s[pos] as sentence from (select doc_id, s, unnest(generate_series(1, len(s))) as pos from (select doc_id, {_SENTENCES} as s from documents))",
    "chunk_text": f"{_CHUNKS} select doc_id, chunk_index::bigint as chunk_index, chunk from cut",
    "chunk_counts": f"{_CHUNKS} select doc_id, count(*) as total_chunks from cut group by doc_id",
    "ingest_local_records": f"""{_CHUNKS}, named as (select doc_id, chunk_index, 'mock summary for: ' || chunk as summary, count(*) over (partition by doc_id) as total_chunks from cut)
select doc_id, chunk_index::bigint as chunk_index, total_chunks, 'text' as modality, case when doc_id % 2 = 0 then 'hybrid_file' else 'text_only' end as storage_mode, 'lzma(6)' as codec, 'text/plain' as mime_type,
 sha256(summary) as summary_sha256, len(list_distinct({_terms('summary')})) as n_tokens, strlen(text) as original_size, upper(sha256(text)) as checksum from named join documents using (doc_id)""",
    "ingest_totals": f"{_CHUNKS} select (select count(*) from documents) as files, count(*) as records, (select sum(strlen(text))::bigint from documents) as original_bytes from cut",
    "request_validation": """with picked as (select doc_id, ['text_only', 'HYBRID_FILE', 'full_raw', null, 'text_only', 'raw', 'text_only', 'full_raw', 'text_only'][(doc_id % 9)::int + 1] as mode,
  ['text', 'Image', null, '', 'document', 'film', 'audio'][(doc_id % 7)::int + 1] as kind, ['{}', '', null, '{"k": 1}', 'no json'][(doc_id % 5)::int + 1] as meta,
  [null, '', '0f8fad5b-d9cb-469f-a165-70867728950e', 'x'][(doc_id % 4)::int + 1] as parent, case when doc_id % 11 = 0 then 15 when doc_id % 13 = 0 then 12 else 16 end as size from documents)
select doc_id, case when mode is null or mode = 'raw' then 'Invalid input: Unknown storage mode: ' || coalesce(mode, 'null') when kind = 'film' then 'Invalid input: Unknown modality: film'
 when meta = 'no json' then 'Invalid input: metadata is no JSON' when parent = 'x' then 'Invalid input: parent_id is no UUID' when size = 15 then 'Invalid input: embedding bytes are no whole floats'
 when size = 12 then 'Invalid input: embedding has 3 values, not 4' end as error from picked""",
    "vault_lifecycle": f"""{_CHUNKS} select doc_id, lang is distinct from 'fr' as found, case when lang = 'fr' then 0 else n end as records, coalesce(lang = 'en', false) as english,
 lang is distinct from 'fr' and doc_id % 2 = 0 and strlen(text) > 0 as fetched from documents join (select doc_id, count(*) as n from cut group by doc_id) using (doc_id)""",
    "parent_rollup": "select conv_id, count(*) as chunks, sha256(string_agg(text, chr(10) order by turn)) as text_sha256 from conversations group by conv_id",
    "vault_stats": """select count(*) as total_records, sum(size) as total_payload_bytes, sum(half) as total_compressed_bytes, round(avg(size / half), 6) as avg_compression_ratio
 from (select strlen(text)::bigint as size, ((strlen(text) + 1) // 2)::bigint as half from documents)""".replace("sum(size)", "sum(size)::bigint").replace("sum(half)", "sum(half)::bigint"),
    "upsert_latest": "select doc_id, case when doc_id % 2 = 0 then n_chars + 1 else n_chars end as n_chars, case when doc_id % 2 = 0 then 2::bigint else 1::bigint end as version from documents",
    "record_exists": "select vec_id as id, vec_id in (select doc_id from documents) as found from embeddings",
    "delete_records": "select doc_id from documents where lang <> 'fr'",
    "incremental_index": f"with {_TOKENS} select token, count(*) as df from tok where doc_id in (select doc_id from documents where lang <> 'fr' and ({_LATER})) group by token",
    "fetch_frames": f"""select doc_id, i as chunk_index, sha256(raw[i * {FRAME} + 1 : (i + 1) * {FRAME}]) as data_sha256, total_bytes
 from (select doc_id, encode(text) as raw, strlen(text)::bigint as total_bytes, unnest(generate_series(0, greatest((strlen(text) - 1) // {FRAME}, 0))) as i from documents)""",
    "payload_sizes": "select doc_id, strlen(text)::bigint as size from documents",
    "payload_ranges": f"""select doc_id, 0::bigint as chunk_index, sha256(encode(text)[{RANGE[0] + 1} : {RANGE[1]}]) as data_sha256, strlen(text)::bigint as total_bytes
 from documents where lang is distinct from 'fr' and (strlen(text) > {RANGE[0]} or true)""",
    "metadata_index": f"select doc_id from documents where lang = 'en' and source = 'src3' and {_MODALITY} = 'text'",
    "index_segments": f"""with {_bm25(queries=f"q as (select 0 as qid, unnest({_query(repr(QUERY_TEXT + ' revised'))}) as token)").replace('from documents)', "from (select doc_id, case when doc_id % 2 = 0 then text || ' revised' else text end as text from documents where lang is distinct from 'fr'))")}
select doc_id, score from scored""",
    "snapshot_reads": """select 'before' as reader, doc_id, n_chars from documents
 union all select 'after', doc_id, case when doc_id % 2 = 0 then n_chars + 1 else n_chars end from documents where lang is distinct from 'fr'""",
    "hybrid_text": _BY_TEXT,
    "search_stream": _BY_TEXT,
    "upload_stream": """select conv_id, 'c' || conv_id as filename, sum(strlen(text))::bigint as n_bytes, sha256(string_agg(text, '' order by turn)) as content_sha256 from conversations where conv_id % 3 <> 0 group by conv_id""",
    "model_answers": """select doc_id, case when length(text) % 7 <> 3 then 'about ' || length(text) || ' ' || sha256(text) end as answer,
 case when length(text) % 7 = 3 then 'Provider error: gone' end as error from documents""",
    "delta_encode": """select vec_id, (i - 1)::bigint as pos, round((case when i = 1 then embedding[1] else embedding[i] - embedding[i - 1] end)::float::double, 4) + 0.0 as delta
 from (select vec_id, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings)""",
    "delta_decode": "select vec_id, true as same from embeddings",
    "select_codec": f"select doc_id, {_CODEC} as codec from (select doc_id, {_MODALITY} as modality from documents)",
    "codec_roundtrip": "select doc_id, octet_length(encode(text))::bigint as size, sha256(text) as sha256 from documents",
    "embedding_codec_roundtrip": "select vec_id, true as same from embeddings",
    "embedding_bytes_roundtrip": "select vec_id, (i - 1)::bigint as pos, embedding[i]::float::double as value from (select vec_id, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings)",
    "checksum_sha256": "select doc_id, sha256(text) as checksum from documents",
    "media_texts": f"""select doc_id, case when doc_id % 3 = 0 then '[Image: OCR not available — install tesseract]' when strlen(seen) < 20 then '[Image: no readable text detected]' else seen end || ' a picture' as image,
 case when doc_id % 2 = 0 then '[Visual]: ' || shots || ' [Audio]: words' else shots end as video
 from (select doc_id, array_to_string({_words('text')}, ' ') as seen, array_to_string({_SENTENCES}, ' | ') as shots from documents)""",
}
