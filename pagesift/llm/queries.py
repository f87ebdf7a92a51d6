"""One query per operator, over the whole given tables with production parameters, and DuckDB SQL where it can say
the same.

Operators without SQL (2: chunk fingerprints, 4 and 10: trained models, 6: token ids, 7: XXH64 fingerprints, 8:
licence expressions, 13: an approximate graph search) are tested against brute-force versions or held-out quality in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.sources.tables import table

from . import ann, clustering, decontamination, fingerprints, licenses, lm, merkle, packing, sharding, simhash, substring_dedup, toxicity, url_filters


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.balanced_shards(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(toxicity.id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False).drop("kept", "text_hash")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated_words(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle.manifest(table(spark, sf_dir, "documents"), tampered, merkle.lower_text())
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))[0]


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_document_fingerprints, op3_sharding, op4_toxicity, op5_substring_dedup, op6_best_fit_packing,
    op7_simhash_near_dedup, op8_license_scans, op9_benchmark_decontamination, op10_lm_scoring,
    op11_merkle_manifest, op12_centroid_clustering, op13_nearest_neighbours)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# CRC-32 byte by byte over a 256-entry table
_CRC = """
crc_table AS (SELECT list(list_reduce(list_concat([n], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS n))"""

_OP3 = f"""
WITH {_CRC},
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT doc_id, strlen(text) + 1 AS size, hex(encode(text)) AS x, strlen(text) AS n FROM d),
c AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(n), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
        lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) AS text_crc32 FROM h, crc_table),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(((2 * before + size) * 8) // (2 * total), 7)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s"""

_OP5 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
kept AS (SELECT x.doc_id, string_agg(x.t, ' ' ORDER BY x.i) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM w) x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

_OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
  FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _judge(host: str, path: str, what: str) -> str:
    order = sorted(url_filters.RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    cases = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h + p if what == 'rule' else kind}'" for kind, h, p in order)
    return f"CASE {cases} END"


def _host(u: str) -> str:
    return _LOWER.format(rf"regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)")


def _path(u: str) -> str:
    return rf"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _alias(u: str) -> str:
    q = rf"regexp_replace(regexp_replace(regexp_extract({u}, '(?s)^[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^&=]*|gclid|fbclid)(=[^&]*)?', '', 'g'), '^&+', '')"
    return (f"CASE WHEN contains({u}, '://') THEN regexp_replace({_host(u)}, ':(80|443)$', '') || regexp_replace({_path(u)}, '/+$', '') || "
            f"CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END ELSE {u} END")


# canonical links and meta refreshes with absolute addresses; the closure over aliases by a recursive query
_OP1 = rf"""
WITH RECURSIVE t AS (SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
e AS (SELECT src, regexp_extract(tag, '(?is)(?:href\s*=\s*|\burl\s*=\s*)[\x22\x27]?([^\x22\x27> ]*://[^\x22\x27> ]*)', 1) AS dst FROM t
  WHERE regexp_matches(tag, '(?is)rel\s*=\s*[\x22\x27]?\s*canonical\b|http-equiv\s*=\s*[\x22\x27]?\s*refresh\b')),
l AS (SELECT {_alias("src")} AS a, {_alias("dst")} AS b FROM e WHERE dst <> ''),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
seeds AS (SELECT DISTINCT {_alias("u")} AS node FROM (SELECT url AS u FROM pages WHERE url IS NOT NULL UNION SELECT src FROM e UNION SELECT dst FROM e WHERE dst <> '')
  WHERE {_judge(_host("u"), _path("u"), "verdict")} = 'block'),
blocked AS (SELECT node FROM seeds UNION SELECT both_ways.b FROM blocked JOIN both_ways ON blocked.node = both_ways.a),
j AS (SELECT page_id, coalesce({_host("url")}, '') AS host, coalesce({_path("url")}, '') AS path, CASE WHEN contains(url, '://') THEN {_alias("url")} END AS node FROM pages)
SELECT page_id, host, path, {_judge("host", "path", "rule")} AS rule,
  coalesce({_judge("host", "path", "verdict")}, CASE WHEN node IN (SELECT node FROM blocked) THEN 'block' END, 'allow') AS verdict FROM j"""



def _merkle_tree(name: str, leaves: str, levels: int) -> str:
    """CTEs of a tree over ``leaves`` (g, i, d, t): <name>p rows (g, i0, path: list of (place, siblings)), <name>r (g, root).
    ``levels`` is the greatest height; a finished tree passes on its top."""
    out = [f"{name}0 AS (SELECT g, i, d, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for k in range(levels):
        out.append(f"{name}u{k} AS (SELECT g, i // 16 AS r, list(d ORDER BY i) AS run, any_value(n) AS n FROM {name}{k} GROUP BY 1, 2)")
        out.append(f"{name}{k + 1} AS (SELECT g, r AS i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d, (n + 15) // 16 AS n FROM {name}u{k})")
    path = "list_concat(" + ", ".join(f"[CASE WHEN u{k}.n > 1 THEN {{'place': (i // {16**k}) % 16, 'run': u{k}.run}} END]" for k in range(levels)) + ")"
    joins = " ".join(f"JOIN {name}u{k} u{k} ON u{k}.g = l.g AND u{k}.r = l.i // {16**(k + 1)}" for k in range(levels))
    out.append(f"{name}p AS (SELECT l.g, l.i, list_filter({path}, lambda x: x IS NOT NULL) AS path FROM {name}0 l {joins})")
    out.append(f"{name}r AS (SELECT g, d AS root FROM {name}{levels})")
    return ",\n".join(out)


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _op11(levels: int = 6) -> str:
    """Trees of up to 16 ** levels leaves."""
    text = _LOWER.format("text")
    fields = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(s)), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT)"
    plain, changed = (f"sha256({' || '.join([*fields, _field(t)])})" for t in ("text", text))
    rest = "list_reduce(list_concat([''], list_transform(path, lambda x: array_to_string(list_concat(x.run[1:x.place], x.run[x.place + 2:]), ''))), lambda a, b: a || b)"
    step = "sha256(array_to_string(list_concat(path[{k}].run[1:path[{k}].place], [f], path[{k}].run[path[{k}].place + 2:]), ''))"
    folds = []
    for k in range(1, 2 * levels + 1):
        folds.append(f"f{k} AS (SELECT doc_id, d, subroot, path, CASE WHEN len(path) >= {k} THEN {step.format(k=k)} ELSE f END AS f FROM f{k - 1})")
    return f"""
WITH {_CRC},
c AS (SELECT doc_id, {crc} % 5 = 0 AS tampered FROM (SELECT doc_id, doc_id::VARCHAR AS s, hex(encode(doc_id::VARCHAR)) AS x FROM documents), crc_table),
leaves AS (SELECT coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, doc_id, {plain} AS d, {changed} AS e FROM documents),
{_merkle_tree('a', 'leaves', levels)},
tops AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, root AS d, g AS source FROM ar),
{_merkle_tree('b', 'tops', levels)},
f0 AS (SELECT l.doc_id, l.d, tops.d AS subroot, list_concat(ap.path, bp.path) AS path, CASE WHEN c.tampered THEN l.e ELSE l.d END AS f
  FROM leaves l JOIN c USING (doc_id) JOIN ap ON ap.g = l.g AND ap.i = l.i JOIN tops ON tops.source = l.g JOIN bp ON bp.i = tops.i),
{", ".join(folds)}
SELECT doc_id, d AS leaf, subroot, root, sha256({rest}) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{2 * levels}, br"""


def _op12(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    near = "list_sum(list_transform(range(1, {d} + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))".format(d=dims)
    parts = [f"""v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
             f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS n, x AS c FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h LIMIT {k}))"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT vec_id, any_value(x) AS x, min((d, n)) AS b FROM (SELECT vec_id, x, n, {near} AS d FROM v, c{r}) GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT n, list(((s - ((s % q) + q) % q) // q) ORDER BY j) AS c FROM (SELECT b[2] AS n, j, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS q
  FROM (SELECT b, unnest(x) AS e, unnest(range(1, {dims} + 1)) AS j FROM a{r}) GROUP BY 1, 2) GROUP BY n)""")
            parts.append(f"c{r + 1} AS (SELECT n, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (n))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, b[2]::INT AS cluster, b[1]::BIGINT AS distance, (sum(b[1]) OVER (PARTITION BY b[2]))::BIGINT AS cluster_inertia, (sum(b[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON n = b[2]"""


ORACLES = {"op1_url_filters": _OP1, "op3_sharding": _OP3, "op5_substring_dedup": _OP5, "op9_benchmark_decontamination": _OP9,
           "op11_merkle_manifest": _op11(), "op12_centroid_clustering": _op12()}
