"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import bpe, conversation_repair, exact_dedup, fill_in_middle, html_text, jaccard_join, language_id, media, mixing, pii, sharding, token_counts, url_filter
from strataweave.llm.shared import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir), width=3, threshold=0.9).select("doc_id", "n_shingles", "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir)).drop("redacted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height"
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir).select("doc_id", "source"), mixing.WEIGHTS)


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.counted(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transform(documents(spark, sf_dir))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair(conversation_repair.damaged(convs), convs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_html_text": op3_html_text,
    "op4_pii_spans": op4_pii_spans,
    "op5_language_id": op5_language_id,
    "op6_media_columns": op6_media_columns,
    "op7_mix_sources": op7_mix_sources,
    "op8_feistel_shards": op8_feistel_shards,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_counts": op10_token_counts,
    "op11_url_filter": op11_url_filter,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Checksums of lists of bytes, by a table of 256 entries.
CRC_TABLE = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) r(i))"
CRC = "xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1])), 4294967295)"


def _weights_sql() -> str:
    return ", ".join(f"('{s}', {w})" for s, w in sorted(mixing.WEIGHTS.items()))


def _rounds_sql(rank: str) -> str:
    """The Feistel network as SQL: columns of the previous round by their aliases, last the place."""
    out = [f"{rank} // d.b AS u0", f"{rank} % d.b AS v0"]
    for r, (k0, k1, k2) in enumerate(sharding.keys(sharding.SEED)):
        side = f"d.{'ab'[r % 2]}"
        t = f"(((v{r} + {k0}) % {sharding.PRIME} * {k1} + {k2}) % {sharding.PRIME})"
        out += [f"v{r} AS u{r + 1}", f"(u{r} + ({t} * {t} + v{r}) % {sharding.PRIME}) % {side} AS v{r + 1}"]
    last = sharding.ROUNDS
    return ", ".join([*out, f"u{last} * d.b + v{last} AS place"])


ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_points,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        k AS (
          SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
    "op2_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
          FROM w),
        n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
        sh AS (SELECT doc_id, unnest(s) AS x FROM s),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL""",
    # Every slot of every period by itself: the earliest deadline among the released blocks.
    "op7_mix_sources": f"""
        WITH RECURSIVE w(pool, w) AS (VALUES {_weights_sql()}),
        g AS (
          SELECT doc_id, source, pool, row_number() OVER (PARTITION BY pool ORDER BY doc_id NULLS FIRST) - 1 AS g
          FROM (SELECT *, CASE WHEN source IN (SELECT pool FROM w) THEN source ELSE '{mixing.REST}' END AS pool FROM documents)),
        n AS (SELECT pool, w, ceil(count(*) / {mixing.BLOCK})::BIGINT AS n FROM g JOIN w USING (pool) GROUP BY ALL),
        s(period, t, names, w, own, rest, done) AS (
          SELECT 0, 0, list(pool ORDER BY pool), list(w ORDER BY pool), list(w ORDER BY pool), list(n ORDER BY pool), list(0 ORDER BY pool)
          FROM n HAVING count(*) > 0
          UNION ALL
          SELECT * FROM (
            SELECT CASE WHEN ended THEN period + 1 ELSE period END AS period, CASE WHEN ended THEN 0 ELSE t + 1 END AS t, names, w,
                   CASE WHEN ended AND dry THEN list_transform(w, lambda x, i: CASE WHEN less[i] > 0 THEN x ELSE 0 END) ELSE own END AS own,
                   CASE WHEN ended THEN less ELSE rest END AS rest,
                   list_transform(done, lambda x, i: CASE WHEN ended THEN 0 WHEN i = pick THEN x + 1 ELSE x END) AS done
            FROM (
              SELECT *, t + 1 = list_sum(own) AS ended,
                     list_bool_or(list_transform(own, lambda x, i: x > rest[i])) AS dry,
                     list_transform(rest, lambda x, i: x - least(x, own[i])) AS less,
                     list_min(list_transform(own, lambda x, i: CASE WHEN done[i] < x AND done[i] * list_sum(own) // x <= t
                       THEN {{'due': ((done[i] + 1) * list_sum(own) + x - 1) // x, 'i': i}} END)).i AS pick
              FROM s)
          ) WHERE list_sum(rest) > 0),
        c AS (
          SELECT period, t, names[pick] AS pool, done[pick] AS i
          FROM (SELECT *, list_min(list_transform(own, lambda x, i: CASE WHEN done[i] < x AND done[i] * list_sum(own) // x <= t
                  THEN {{'due': ((done[i] + 1) * list_sum(own) + x - 1) // x, 'i': i}} END)).i AS pick FROM s)
          WHERE done[pick] < rest[pick]),
        b AS (
          SELECT *, row_number() OVER (ORDER BY period, t) - 1 AS slot, row_number() OVER (PARTITION BY pool ORDER BY period, t) - 1 AS block,
                 count(*) OVER (PARTITION BY period) AS total, count(*) OVER (PARTITION BY period, pool) AS own FROM c),
        r AS (SELECT *, min(slot) OVER (PARTITION BY period) AS base FROM b)
        SELECT doc_id, source, pool, block, slot, base + i * total // own AS release, base + ((i + 1) * total + own - 1) // own AS deadline,
               row_number() OVER (ORDER BY slot, g) - 1 AS position
        FROM (SELECT *, g // {mixing.BLOCK} AS block FROM g) JOIN r USING (pool, block)""",
    # The checksum by its table of 256 entries; a place beyond the rows is permuted again.
    "op8_feistel_shards": f"""
        WITH RECURSIVE t AS (
          SELECT list(v ORDER BY i) AS t
          FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) r(i))),
        e AS (
          SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
                 list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
          FROM documents),
        k AS (SELECT doc_id, size, xor(list_reduce([4294967295] || bytes, lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1])), 4294967295) AS text_crc32 FROM e, t),
        g AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM k),
        m AS (SELECT count(*) AS n, (SELECT max(i) FROM range(100000) r(i) WHERE i * i <= greatest((SELECT count(*) FROM documents) - 1, 0)) + 1 AS a FROM g),
        d AS (SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM m),
        p(row_number, x) AS (
          SELECT row_number, place FROM (SELECT row_number, {_rounds_sql("row_number")} FROM g, d)
          UNION ALL
          SELECT row_number, place FROM (SELECT row_number, {_rounds_sql("x")} FROM p, d WHERE x >= d.n))
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (x % {sharding.SHARDS})::INTEGER AS shard, (x // {sharding.SHARDS})::BIGINT AS slot,
               NULL::INTEGER AS grown_shard, row_number
        FROM g JOIN p USING (row_number), d WHERE x < d.n""",
    "op12_fill_in_middle": """
        WITH h AS (
          SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
                 list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), i, 8))::BIGINT) AS h
          FROM documents),
        c AS (
          SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
          FROM h),
        p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
    # Row by row: of each state of the grammar (nothing, after s, u, a) the least (cost, audit) so far, insertions first.
    "op13_conversation_repair": f"""
        WITH RECURSIVE t AS ({CRC_TABLE}),
        d AS (SELECT *, {CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS what FROM conversations, t),
        r AS (
          SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                 CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
          FROM d, range(2) again(k) WHERE what <> 0 AND (k = 0 OR what = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM r),
        f AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                 rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
          FROM o),
        g AS (
          SELECT conv_id, turn, i, role, text, left(role, 1) AS z, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS y,
                 CASE WHEN said = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
          FROM f),
        s(conv_id, i, q0, qs, qu, qa) AS (
          SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'e': ''}}, {{'c': NULL::INT, 'e': ''}}, {{'c': NULL::INT, 'e': ''}}, {{'c': NULL::INT, 'e': ''}} FROM conversations
          UNION ALL
          SELECT conv_id, i, q0,
                 CASE WHEN ks.c IS NULL OR ds < ks THEN ds ELSE ks END, list_min(list_filter([du, ku, ru], lambda x: x.c IS NOT NULL)), list_min(list_filter([da, ka, ra], lambda x: x.c IS NOT NULL))
          FROM (
            SELECT conv_id, i, {{'c': q0.c + 2, 'e': q0.e || 'D'}} AS q0, {{'c': qs.c + 2, 'e': qs.e || 'D'}} AS ds,
                   CASE WHEN ok AND z = 's' THEN {{'c': q0.c + more, 'e': q0.e || 'K'}} ELSE {{'c': NULL::INT, 'e': ''}} END AS ks,
                   {{'c': u.c + 2, 'e': u.e || 'D'}} AS du, {{'c': a.c + 2, 'e': a.e || 'D'}} AS da,
                   CASE WHEN ok AND z = 'u' THEN {{'c': before.c + more, 'e': before.e || 'K'}} ELSE {{'c': NULL::INT, 'e': ''}} END AS ku,
                   CASE WHEN ok THEN {{'c': before.c + 1 + more, 'e': before.e || 'R'}} ELSE {{'c': NULL::INT, 'e': ''}} END AS ru,
                   CASE WHEN ok AND z = 'a' THEN {{'c': u.c + more, 'e': u.e || 'K'}} ELSE {{'c': NULL::INT, 'e': ''}} END AS ka,
                   CASE WHEN ok THEN {{'c': u.c + 1 + more, 'e': u.e || 'R'}} ELSE {{'c': NULL::INT, 'e': ''}} END AS ra
            FROM (
              SELECT *, list_min(list_filter([q0, qs, a], lambda x: x.c IS NOT NULL)) AS before
              FROM (
                SELECT *, list_min(list_filter([qa, {{'c': u.c + 5, 'e': u.e || 'I'}}], lambda x: x.c IS NOT NULL)) AS a
                FROM (
                  SELECT s.conv_id, g.i, q0, qs, qa, g.z, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more,
                         list_min(list_filter([qu, {{'c': q0.c + 5, 'e': q0.e || 'I'}}, {{'c': qs.c + 5, 'e': qs.e || 'I'}}, {{'c': qa.c + 5, 'e': qa.e || 'I'}}], lambda x: x.c IS NOT NULL)) AS u
                  FROM s JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.i + 1)))) ),
        l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        b AS (
          SELECT conv_id, list_min(list_filter([q0, qa, {{'c': qu.c + 5, 'e': qu.e || 'I'}}, {{'c': q0.c + 10, 'e': q0.e || 'II'}}, {{'c': qs.c + 10, 'e': qs.e || 'II'}}], lambda x: x.c IS NOT NULL)) AS b FROM l),
        x AS (
          SELECT conv_id, p, b.e[p] AS edit, length(regexp_replace(b.e[1:p], 'I', '', 'g')) AS i, length(regexp_replace(b.e[1:p], 'D', '', 'g')) AS o
          FROM b, unnest(range(1, length(b.e) + 1)) e(p)),
        w AS (
          SELECT x.*, g.role, g.text, g.z, max(o = 1 AND edit = 'K' AND z = 's') OVER (PARTITION BY x.conv_id) AS led
          FROM x LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id AND g.i = x.i),
        v AS (
          SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said
          FROM w WHERE edit <> 'D' GROUP BY 1),
        n AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND y || z NOT IN ('su', 'ua', 'au')) AS illegal
          FROM g GROUP BY 1)
        SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               b.b.c::BIGINT AS cost, b.b.e AS audit, sha256(coalesce(said, '')) AS repaired_sha256
        FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM b.conv_id""",
}
