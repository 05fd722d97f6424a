"""The training-data queries (one per operator) and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op4_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mpegts import store_and_probe

    return store_and_probe(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    read = archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import fill_in_middle, restored

    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


#: The rules that op13 judges by.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_simhash": op1_simhash, "op2_toxicity": op2_toxicity, "op9_language": op9_language, "op3_neighbours": op3_neighbours, "op4_mpegts": op4_mpegts, "op5_packing": op5_packing, "op6_main_text": op6_main_text, "op7_passages": op7_passages, "op8_warc": op8_warc, "op10_bpe": op10_bpe,
    "op11_infill": op11_infill, "op12_phrases": op12_phrases, "op13_urls": op13_urls,
}
#: The other operators hold fingerprints, models, searches or token ids, which SQL cannot express.
ORACLE_SQL: dict[str, str] = {
    "op8_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
n AS (SELECT h, max(page_id) AS newest FROM d GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(h, 1 + 5 * (i // 4), 5) AS bigint) >> (15 - 5 * (i % 4))) & 31 AS integer) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM d JOIN n USING (h)""",
    "op11_infill": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', doc_id)) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
u AS (SELECT doc_id, text, t, len(t) AS n, list_transform(range(4), lambda i: cast('0x' || substr(h, 1 + 8 * i, 8) AS bigint)) AS h FROM d),
c AS (SELECT doc_id, text, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
    WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""",
    "op12_phrases": r"""WITH w AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
n AS (SELECT lang, cast(sum(len(w)) AS bigint) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(m))),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY lang, m, phrase HAVING count(*) >= 10),
c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE m > 1),
longer AS (SELECT DISTINCT b.lang, b.phrase FROM c b JOIN (SELECT lang, a, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS phrase FROM c WHERE m = 3) t
  ON t.lang = b.lang AND t.phrase = b.phrase WHERE b.m = 2 AND 100 * t.a >= 50 * b.a),
k AS (SELECT lang, phrase, a, array_to_string(s[1:k], ' ') AS first, array_to_string(s[k + 1:], ' ') AS rest, k
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c ANTI JOIN longer USING (lang, phrase))),
p AS (SELECT k.*, x.a AS l, y.a AS r, cast((1000000::hugeint * k.a * k.a) // (x.a::hugeint * y.a) AS bigint) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.first JOIN f y ON y.lang = k.lang AND y.phrase = k.rest),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op13_urls": r"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT *, '.' || host AS dotted, string_split(regexp_replace(path, '[0-9]+', '{n}', 'g'), '/') AS s FROM p),
r AS (SELECT page_id, host, path, CASE WHEN len(s) <= 9 THEN s ELSE list_append(s[1:8], '**') END AS shape,
  CASE WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM d),
t AS (SELECT host, shape, count(*) AS n, count(rule) AS l, count(*) FILTER (rule IN ('example.com/en/', 'net/es/', 'net/fr/')) AS b FROM r GROUP BY host, shape),
z AS (SELECT (coalesce(sum(b), 0) + 1e0) / (coalesce(sum(l), 0) + 2) AS share FROM t),
e AS (SELECT *, array_to_string(shape[1:i], '/') AS above, shape[i + 1] AS branch, CASE WHEN shape[i + 2] IS NULL THEN '/' ELSE concat(CASE WHEN contains(shape[i + 2], '{n}') THEN shape[i + 2] ELSE 'w' END, '/', len(shape) - i) END AS below FROM (SELECT *, unnest(range(1, len(shape))) AS i FROM t)),
g AS (SELECT host, i, above, branch, below, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM e GROUP BY ALL),
k AS (SELECT host, i, above, branch, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM g GROUP BY ALL),
w AS (SELECT host, i, above, below, sum(n) AS m FROM g GROUP BY ALL),
o AS (SELECT host, i, above, count(*) AS kids, sum(n) AS an, sum(l) AS al, sum(b) AS ab FROM k GROUP BY ALL),
f AS (SELECT host, i, above, count(*) - 1 AS df FROM w GROUP BY ALL),
x AS (SELECT host, i, above, branch, sum(n * n / m) AS squares FROM g JOIN w USING (host, i, above, below) GROUP BY ALL),
c AS (SELECT host, i, above, branch, kids >= 8 AND n < 4 AS variable, an * squares / n - n <= df + 3e0 * sqrt(2 * df)
    AND NOT pow(cast(b AS double) * (al - l) - cast(ab - b AS double) * l, 2) * al > 3.84e0 * l * (al - l) * ab * (al - ab) AS alike
  FROM k JOIN x USING (host, i, above, branch) JOIN o USING (host, i, above) JOIN f USING (host, i, above)),
v AS (SELECT host, i, above, branch, CASE WHEN variable OR alike AND count(*) FILTER (alike) OVER (PARTITION BY host, i, above) > 1 THEN '*' ELSE branch END AS name FROM c),
y AS (SELECT host, shape, concat_ws('/', shape[1], string_agg(name, '/' ORDER BY i)) AS template FROM t LEFT JOIN (SELECT host, shape, i, above, branch FROM e) q USING (host, shape)
  LEFT JOIN v USING (host, i, above, branch) GROUP BY host, shape),
j AS (SELECT host, template, (sum(b) + share * (sum(n) - sum(l) + 2)) / (sum(n) + 2) AS purity FROM y JOIN t USING (host, shape), z GROUP BY host, template, share)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN purity >= .8e0 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN y USING (host, shape) JOIN j USING (host, template)""",
}
