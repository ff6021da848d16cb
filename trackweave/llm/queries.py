"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.line_dedup import near_lines

    return near_lines(read(spark, sf_dir, "documents"))


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages' archive files in which some records are altered, cut short, lost or added."""
    from trackweave.llm.fixity import audit_pages

    return audit_pages(read(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.quality import score_quality

    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.toxicity import score_toxicity

    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).drop("ids")


def op7_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.neighbours import nearest

    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 100 = 0"), vectors)


def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.language import identify

    return identify(read(spark, sf_dir, "documents"))


def op9_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.decontaminate import digest, find_overlaps

    return digest(find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op11_ternary_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.prefix_trie import rebuilt_trie

    return rebuilt_trie(read(spark, sf_dir, "conversations"))


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"))


def op13_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackweave.llm.minhash import near_copies

    return near_copies(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_merkle_fixity, op3_simhash_near_dedup, op4_pairwise_quality, op5_compression_toxicity,
        op6_hilbert_packing, op7_block_neighbours, op8_byte_cnn_language, op9_viterbi_token_counts, op10_fm_decontamination,
        op11_ternary_prefix_trie, op12_lanczos_whitening, op13_tensored_minhash,
    )
}
#: A-Z to lower case, as text for translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH texts AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS tag, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        parts AS (SELECT doc_id, tag, string_split(text, chr(10)) AS l FROM texts),
        numbered AS (SELECT doc_id, tag, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM parts),
        lines AS (
            SELECT doc_id, tag, line_no, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '[^ \\x09-\\x0D]+') AS w FROM numbered
        ),
        held AS (SELECT *, row_number() OVER (ORDER BY doc_id, tag, line_no) AS place, array_to_string(w, ' ') AS whole FROM lines WHERE len(w) > 0),
        firsts AS (SELECT whole, min(place) AS place, any_value(w) AS w FROM held GROUP BY whole),
        cut AS (
            SELECT place, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v
            FROM (SELECT place, w, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 5)
        ),
        swapped AS (SELECT v, i, min(place) AS place FROM cut GROUP BY v, i),
        shorter AS (SELECT v, min(place) AS place FROM cut GROUP BY v),
        near AS (
            SELECT a.place FROM cut a JOIN swapped b ON a.v = b.v AND a.i = b.i WHERE b.place < a.place
            UNION SELECT a.place FROM cut a JOIN firsts b ON a.v = b.whole WHERE b.place < a.place
            UNION SELECT a.place FROM firsts a JOIN shorter b ON a.whole = b.v WHERE b.place < a.place
        ),
        state AS (SELECT f.whole, f.place, n.place IS NOT NULL AS near FROM firsts f LEFT JOIN near n ON f.place = n.place),
        marks AS (SELECT h.doc_id, h.tag, h.line_no, s.near OR h.place > s.place AS gone FROM held h JOIN state s ON h.whole = s.whole),
        sums AS (
            SELECT doc_id, tag, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (gone) AS removed_lines
            FROM marks GROUP BY doc_id, tag
        )
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed_lines, '') AS removed_lines
        FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id AND CAST('0x' || substr(md5(d.text), 1, 15) AS BIGINT) = s.tag""",
    "op2_merkle_fixity": """
        WITH bodies AS (
            SELECT page_id, 'pages-' || CAST(page_id // 256 AS VARCHAR) || '.warc' AS file, coalesce(url, '') AS url, coalesce(html, '') AS html
            FROM pages WHERE page_id IS NOT NULL
        ),
        records AS (
            SELECT page_id, file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR)
                || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR)
                || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS payload
            FROM bodies
        ),
        placed AS (SELECT *, coalesce(sum(strlen(payload)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM records),
        replica AS (
            SELECT *, CASE page_id % 97 WHEN 5 THEN left(payload, length(payload) - 2) || '?!' WHEN 60 THEN left(payload, length(payload) // 2) ELSE payload END AS other
            FROM placed
        )
        SELECT page_id, file, CAST(pos AS BIGINT) AS "offset", CAST(strlen(payload) AS BIGINT) AS length, CASE page_id % 97 WHEN 31 THEN 'missing' ELSE 'changed' END AS status,
            sha256('leaf:' || payload) AS leaf_a, CASE page_id % 97 WHEN 31 THEN NULL ELSE sha256('leaf:' || other) END AS leaf_b
        FROM replica WHERE page_id % 97 = 31 OR sha256('leaf:' || payload) <> sha256('leaf:' || other)
        UNION ALL
        SELECT page_id, file, CAST(pos + 1 AS BIGINT), CAST(strlen('stray ' || CAST(page_id AS VARCHAR)) AS BIGINT), 'extra', NULL, sha256('leaf:stray ' || CAST(page_id AS VARCHAR))
        FROM replica WHERE page_id % 97 = 77""",
    "op7_block_neighbours": """
        WITH vectors AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
                AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
        ),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
            FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10""",
    "op10_fm_decontamination": f"""
        WITH item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ),
        starts AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0),
        windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM starts),
        sizes AS (SELECT DISTINCT size FROM windows),
        doc_words AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ),
        places AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size),
        phrases AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM places),
        found AS (SELECT p.rid, p.i, p.size, w.item FROM phrases p JOIN windows w ON p.size = w.size AND p.phrase = w.phrase),
        hits AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS k FROM found) GROUP BY rid),
        named AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
            sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN hits h ON d.rid = h.rid LEFT JOIN named n ON d.rid = n.rid""",
    "op11_ternary_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS t
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        placed AS (SELECT conv_id, t, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) - 1 AS pos FROM turns),
        ids AS (
            SELECT conv_id, conv_id - conv_id % 5 AS base, list_reduce(
                list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
                lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(a, x)), 4294967295
            ) AS state FROM (SELECT DISTINCT conv_id FROM placed)
        ),
        convs AS (SELECT conv_id, base, xor(state, 4294967295) % 9 AS h FROM ids),
        parts AS (
            SELECT c.conv_id, 0 AS own, pos, t, size FROM convs c JOIN placed p ON p.conv_id = c.base WHERE pos < h
            UNION ALL SELECT c.conv_id, 1, pos, t, size FROM convs c JOIN placed p ON p.conv_id = c.conv_id WHERE pos >= h
        ),
        rebuilt AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(t, '/') OVER w AS path, size FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
        prefixes AS (
            SELECT conv_id, depth, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent, size FROM rebuilt
            UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM convs
        ),
        nodes AS (SELECT path, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM prefixes GROUP BY path, depth),
        kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
        ends AS (
            SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
            FROM (SELECT conv_id, path FROM prefixes QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY path
        ),
        sums AS (
            SELECT p.path, count(*) FILTER (k.n IS NULL) AS leaves, sum((b.n - 1) * b.size) AS saved
            FROM nodes b LEFT JOIN kids k ON k.parent = b.path JOIN prefixes p ON p.conv_id = b.conv_id AND p.depth <= b.depth GROUP BY p.path
        )
        SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(a.n AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
            CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM nodes a JOIN sums s ON s.path = a.path LEFT JOIN nodes u ON u.path = a.parent LEFT JOIN kids k ON k.parent = a.path LEFT JOIN ends e ON e.path = a.path""",
}
