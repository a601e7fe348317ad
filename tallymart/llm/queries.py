"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"), text=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import vector_dedup

    return vector_dedup(table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import minhash_dedup

    return minhash_dedup(table(spark, sf_dir, "documents"), size=3, percent=85)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import grade_documents, grade_of

    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", grade_of("quality", "toxic").alias("grade")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repair_conversations

    conversations = table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(conversations), conversations)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants, word_counts

    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), slip=97))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_line_dedup, op3_minhash_dedup, op4_suffix_dedup, op5_quality, op6_packing, op7_language_id, op8_token_counts, op9_vector_dedup, op10_decontamination, op11_conversation_repair, op12_spelling_variants, op13_nearest)}
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: CRC-32 of a string as a macro of two steps: the table from its rule, then byte by byte.
CRC_TABLE = "t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"
HEX = "'123456789ABCDEF'"


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string, beside the table t."""
    h = f"hex(encode({text}))"
    octets = f"list_transform(range(length({h}) // 2), lambda i: CAST(16 * instr({HEX}, substr({h}, 2 * i + 1, 1)) + instr({HEX}, substr({h}, 2 * i + 2, 1)) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"


SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _edit(way: str, cost: str, letter: str, line: str = "''") -> str:
    """SQL for a way {cost, edits, text} with one more edit; null stays null."""
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'e': {way}.e || '{letter}', 'o': {way}.o || {line}}} END"


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _insert(way: str, role: str) -> str:
    return _edit(f"({way})", "3", "I", f"chr(10) || '{role}:'")


def _taken(way: str, role: str) -> list[str]:
    """Keep or rerole a row to the role that comes next."""
    fits = f"{way} IS NOT NULL AND fault NOT IN ('b', 'd')"
    cost = "CASE WHEN fault = 't' THEN 3 ELSE 0 END"
    keep = _edit(way, cost, "K", "chr(10) || role || ':' || text")
    return [f"CASE WHEN {fits} AND initial = '{role[0]}' THEN {keep} END", f"CASE WHEN {fits} THEN {_edit(way, f'3 + {cost}', 'R', f"chr(10) || '{role}:' || text")} END"]


#: Ways to be in one of four states after each row, all carried along.
WAYS = f"""SELECT conv_id, i, {_edit("s0", "4", "D")} AS s0,
  {_least(_edit("s1", "4", "D"), "CASE WHEN s0 IS NOT NULL AND fault NOT IN ('b', 'd') AND initial = 's' THEN " + _edit("s0", "CASE WHEN fault = 't' THEN 3 ELSE 0 END", "K", "chr(10) || role || ':' || text") + " END")} AS s1,
  {_least(_edit("i2", "4", "D"), *_taken("s0", "user"), *_taken("s1", "user"), *_taken("i3", "user"))} AS s2, {_least(_edit("i3", "4", "D"), *_taken("i2", "assistant"))} AS s3
  FROM (SELECT f.*, s0, s1, {_least("s2", _insert("s0", "user"), _insert("s1", "user"), _insert("s3", "user"))} AS i2,
   {_least("s3", _insert("s2", "assistant"), _insert(_insert("s0", "user"), "assistant"), _insert(_insert("s1", "user"), "assistant"))} AS i3 FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1)"""

#: Trained or searched results (5, 6, 7, 8) have no SQL; they are tested against brute force and on held-out rows.
ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""WITH u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
 k AS (SELECT doc_id, i, md5(string_agg(word, ' ') OVER w) AS key, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
 f AS (SELECT key, min(doc_id) AS first FROM k WHERE n = 13 GROUP BY key),
 g AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i FROM k JOIN f USING (key) WHERE n = 13 AND doc_id > first), range(13) r(j)),
 m AS (SELECT u.*, g.i IS NOT NULL AS gone FROM u LEFT JOIN g USING (doc_id, i))
 SELECT d.doc_id, count(m.i) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY m.i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id""",
    "op2_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
 k AS (SELECT *, translate(trim(line, {SPACE}), {LOWER}) AS key FROM l), f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key),
 g AS (SELECT k.*, length(key) >= 10 AND doc_id > first AS gone FROM k JOIN f USING (key))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id""",
    "op3_minhash_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id, d.doc_id <= coalesce(least, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id""",
    "op4_suffix_dedup": """WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents), w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS key FROM (SELECT doc_id, h, unnest(range(greatest(0, length(h) // 2 - 49))) AS i FROM d)),
 f AS (SELECT key, min(doc_id) AS first FROM w GROUP BY key), g AS (SELECT doc_id, i FROM w JOIN f USING (key) WHERE doc_id > first),
 b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g), k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
 s AS (SELECT doc_id, run, min(i) AS low, max(i) + 50 AS high FROM k GROUP BY ALL), p AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM s),
 t AS (SELECT doc_id, count(*) AS n_spans, sum(high - low) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept, max(high) AS last FROM p JOIN d USING (doc_id) GROUP BY 1)
 SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op9_vector_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, e FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
 SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op10_decontamination": rf"""WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word FROM dw),
 bw AS (SELECT item_id, ws, least(len(ws), 10) AS width FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
 bk AS (SELECT DISTINCT item_id, width, array_to_string(ws[i : i + width - 1], ' ') AS key FROM (SELECT *, unnest(range(1, len(ws) - width + 2)) AS i FROM bw)),
 dk AS (SELECT doc_id, i, width, array_to_string(ws[i : i + width - 1], ' ') AS key FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM dw, (SELECT DISTINCT width FROM bw))),
 h AS (SELECT doc_id, i, width, item_id FROM dk JOIN bk USING (width, key)),
 p AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(width)) AS j FROM h) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id),
 c AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op12_spelling_variants": rf"""WITH RECURSIVE {CRC_TABLE},
 r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[a-zÀ-ÿ]+')) AS run FROM documents),
 c AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 5 GROUP BY ALL),
 h AS (SELECT run, k, {crc_sql("concat(doc_id, ':', run)")} AS h FROM c, t),
 m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM h),
 w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
 d AS (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
 p AS (SELECT x.word, y.word AS other, y.n AS k FROM d x JOIN d y ON x.a = y.a AND x.b = y.b AND x.word != y.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.a || d.b = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.a || d.b = w.word),
 g AS (SELECT word, count(*) AS n_near, max(k) AS k FROM p GROUP BY word), o AS (SELECT p.word, g.n_near, p.k, min(other) AS other FROM p JOIN g ON p.word = g.word AND p.k = g.k GROUP BY ALL),
 f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN k >= 2 * n THEN other END AS form, CASE WHEN k >= 2 * n THEN k END AS form_n FROM w LEFT JOIN o ON o.word = w.word),
 u AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT u.word, f.form FROM u JOIN f ON f.word = u.root WHERE f.form IS NOT NULL),
 z AS (SELECT u.word, u.root FROM u JOIN f ON f.word = u.root WHERE f.form IS NULL)
 SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN z ON z.word = f.word""",
    "op11_conversation_repair": rf"""WITH RECURSIVE {CRC_TABLE},
 x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations, t),
 y AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM x WHERE k != 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM y),
 z AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, rtrim(text, {SPACE}) AS body, left(role, 1) AS initial FROM o),
 f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM z),
 c AS (SELECT DISTINCT conv_id FROM conversations),
 w AS (SELECT CAST({{'c': 0, 'e': '', 'o': ''}} AS STRUCT(c BIGINT, e VARCHAR, o VARCHAR)) AS empty),
 dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, empty AS s0, CASE WHEN false THEN empty END AS s1, CASE WHEN false THEN empty END AS s2, CASE WHEN false THEN empty END AS s3 FROM c, w UNION ALL {WAYS}),
 e AS (SELECT conv_id, {_least("s0", "s3", _insert("s2", "assistant"), _insert(_insert("s1", "user"), "assistant"))} AS way FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
 g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
 SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, way.c AS cost, way.e AS audit, sha256(substr(way.o, 2)) AS repaired_sha256
 FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id""",
}
