"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.llm import (
    exact, fingerprint, forest, hashtree, lines, negatives, packing, passages, pieces, private, quality, tokens, turns,
)
from rubrica.llm.base import read_documents

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read_documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(read_documents(spark, sf_dir))


def op3_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.private_report(read_documents(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_dedup(read_documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(read_documents(spark, sf_dir), labels)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read_documents(spark, sf_dir))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(read_documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))


# 24 shards in two regions of three racks.
TREE = hashtree.grid(2)


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashtree.assign(read_documents(spark, sf_dir), TREE, hashtree.grown(TREE))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("vec_id")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id",
        F.col("embedding").alias("vector"),
        F.when(id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        (id % 100 == 0).alias("anchor"),
    )
    return negatives.mine(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_passages, op2_fingerprints, op3_private, op4_near_dedup, op5_token_counts, op6_quality, op7_packing, op8_exact_dedup,
        op9_line_dedup, op10_pieces, op11_shards, op12_turn_repair, op13_hard_negatives,
    )
}

# CRC-32 of hexadecimal bytes ``h`` by the table ``t`` of all single bytes.
_CRC_TABLE = """
        crc_steps(i, k, c) AS (
            SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
            UNION ALL
            SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END
            FROM crc_steps WHERE k < 8),
        crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""
_CRC = """xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT,
                         list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


def _leaves() -> str:
    return ", ".join(
        f"({more}, '{region}', '{rack}', {shard}, {weight}::DOUBLE)"
        for more, tree in enumerate((TREE, hashtree.grown(TREE)))
        for region, rack, shard, weight in tree
    )


def _draw(level: int, child: str) -> str:
    digits = f"substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{level}:' || {child}), 1, 13)"
    return f"-ln((('0x' || {digits})::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / w"


ORACLES: dict[str, str] = {
    "op11_shards": f"""
        WITH RECURSIVE {_CRC_TABLE},
        tree(more, region, rack, shard, weight) AS (VALUES {_leaves()}),
        regions AS (SELECT more, region, sum(weight) AS w FROM tree GROUP BY ALL),
        racks AS (SELECT more, region, rack, sum(weight) AS w FROM tree GROUP BY ALL),
        shards AS (SELECT more, rack, shard, sum(weight) AS w FROM tree GROUP BY ALL),
        d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        a AS (SELECT id, doc_id, more, arg_min(region, {_draw(0, "region")}) AS region
              FROM (SELECT id, doc_id FROM d), regions GROUP BY ALL),
        b AS (SELECT id, doc_id, more, region, arg_min(rack, {_draw(1, "rack")}) AS rack
              FROM a JOIN racks USING (more, region) GROUP BY ALL),
        c AS (SELECT id, more, region, rack, arg_min(shard, {_draw(2, "shard")}) AS shard
              FROM b JOIN shards USING (more, rack) GROUP BY ALL),
        s AS (SELECT id, doc_id, (len(h) // 2 + 8)::BIGINT AS size, {_CRC}::BIGINT AS text_crc32 FROM d, crc_table)
        SELECT doc_id, size, text_crc32, 'key' AS law, x.shard, x.region, x.rack, y.shard AS grown_shard,
               row_number() OVER (PARTITION BY x.shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
        FROM s JOIN c AS x ON s.id = x.id AND x.more = 0 JOIN c AS y ON s.id = y.id AND y.more = 1
    """,
    "op12_turn_repair": f"""
        WITH RECURSIVE {_CRC_TABLE},
        k AS (SELECT *, {_CRC} % 20 AS kind
              FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                           hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h
                    FROM conversations), crc_table),
        x AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
              FROM k WHERE kind <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                     regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid FROM x),
        f AS (SELECT *, solid = '' AS blank, solid <> '' AND again AS duplicate,
                     solid <> '' AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated,
                     lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
        gap(src, mid, ins, price, lines) AS (VALUES
            ('n', 'n', '', 0, ''), ('s', 's', '', 0, ''), ('u', 'u', '', 0, ''), ('a', 'a', '', 0, ''),
            ('n', 'u', 'I', 5, E'user:\n'), ('s', 'u', 'I', 5, E'user:\n'), ('a', 'u', 'I', 5, E'user:\n'),
            ('u', 'a', 'I', 5, E'assistant:\n'), ('n', 'a', 'II', 10, E'user:\nassistant:\n'),
            ('s', 'a', 'II', 10, E'user:\nassistant:\n')),
        edit(mid, letter, dst) AS (VALUES
            ('n', 'D', 'n'), ('s', 'D', 's'), ('u', 'D', 'u'), ('a', 'D', 'a'),
            ('n', 'K', 's'), ('n', 'K', 'u'), ('s', 'K', 'u'), ('a', 'K', 'u'), ('u', 'K', 'a'),
            ('n', 'R', 'u'), ('s', 'R', 'u'), ('a', 'R', 'u'), ('u', 'R', 'a')),
        p(conv_id, i, state, cost, audit, body) AS (
            SELECT DISTINCT conv_id, 0::BIGINT, 'n', 0, '', '' FROM f
            UNION ALL
            SELECT conv_id, i, dst, cost, audit, body FROM (
                SELECT p.conv_id, f.i, dst, audit || ins || letter AS audit,
                       p.cost + price + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
                           + CASE WHEN truncated AND letter <> 'D' THEN 5 ELSE 0 END AS cost,
                       body || lines || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10)
                           ELSE CASE dst WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text || chr(10) END AS body,
                       row_number() OVER (PARTITION BY p.conv_id, dst ORDER BY
                           p.cost + price + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
                           + CASE WHEN truncated AND letter <> 'D' THEN 5 ELSE 0 END, audit || ins || letter) AS nth
                FROM p JOIN f ON p.conv_id = f.conv_id AND f.i = p.i + 1
                JOIN gap ON src = state JOIN edit ON edit.mid = gap.mid
                WHERE letter = 'D' OR (NOT blank AND NOT duplicate AND (letter = 'R' OR left(role, 1) = dst)))
            WHERE nth = 1),
        e AS (SELECT conv_id, cost + price AS cost, audit || ins AS audit, body || lines AS body
              FROM p JOIN gap ON src = state WHERE mid IN ('n', 'a') AND (p.i > 0 OR ins = '')
              AND p.i = (SELECT max(i) FROM f WHERE f.conv_id = p.conv_id)),
        b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
                     count(*) FILTER (WHERE truncated) AS truncated,
                     count(*) FILTER (WHERE before IS NOT NULL
                         AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
              FROM f GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
               sha256(CASE WHEN coalesce(body, '') = '' THEN '' ELSE left(body, length(body) - 1) END) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN g USING (conv_id) LEFT JOIN b USING (conv_id)
    """,
    "op13_hard_negatives": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id,
                          CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
                     list_inner_product(a.q, b.q)::BIGINT AS score
              FROM v AS a, v AS b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
        p AS (SELECT * FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score,
               n.vec_id AS negative_id, n.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id)::INT AS rank
        FROM p JOIN s AS n ON n.anchor = p.anchor AND NOT n.same
             AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        QUALIFY rank <= 5
    """,
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
               sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op9_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        n AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
        c AS (SELECT doc_id, l[i] AS line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
              FROM n WHERE regexp_matches(l[i], '[^\x20\x09-\x0D]')),
        p AS (SELECT doc_id, i, lead(i) OVER w AS j, line || chr(10) || lead(line) OVER w AS body
              FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, i) > 1 AS gone
              FROM p WHERE j IS NOT NULL),
        x AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM g WHERE gone),
        m AS (SELECT n.doc_id, n.i, l[n.i] AS line, x.i IS NOT NULL AS gone,
                     coalesce(content.k, 0) AS k FROM n LEFT JOIN x ON n.doc_id = x.doc_id AND n.i = x.i
              LEFT JOIN c AS content ON n.doc_id = content.doc_id AND n.i = content.i),
        r AS (SELECT *, max(CASE WHEN gone THEN i END) OVER w AS last_gone,
                     max(CASE WHEN NOT gone AND k > 0 THEN i END) OVER w AS last_kept
              FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        -- A blank line between two lines that go, with none that stays between them, goes too.
        t AS (SELECT *, gone OR (k = 0 AND last_gone > coalesce(last_kept, 0) AND
                     coalesce(min(CASE WHEN gone THEN i END) OVER v <
                              coalesce(min(CASE WHEN NOT gone AND k > 0 THEN i END) OVER v, 9e18), false)) AS cut
              FROM r WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, cut ORDER BY i) AS island FROM t),
        u AS (SELECT doc_id, min(i) - 1 AS first, count(*) AS lines FROM s WHERE cut GROUP BY doc_id, island),
        a AS (SELECT doc_id, sum(lines)::BIGINT AS n_cut, string_agg(concat_ws(':', first, lines), ',' ORDER BY first) AS cut
              FROM u GROUP BY doc_id),
        b AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut) AS body FROM t GROUP BY doc_id)
        SELECT b.doc_id, coalesce(n_cut, 0) AS n_cut, coalesce(a.cut, '') AS cut, sha256(coalesce(body, '')) AS text_sha256
        FROM b LEFT JOIN a ON a.doc_id = b.doc_id
    """,
}
