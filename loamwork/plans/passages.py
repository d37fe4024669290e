"""Text, span, passage and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.functions import text as X
from loamwork.operators import passages, spans
from loamwork.operators.decoding import Chain, best_tags
from loamwork.operators.donors import best_donor
from loamwork.plans.bindings import GOLD_SQL, gold
from loamwork.sources.tables import table

_SEG = r"[^。！？!?；;\n]*[。！？!?；;]|[^。！？!?；;\n]+|\n+"


def text_segments(spark, sf_dir):
    seg = F.explode(X.segments(F.col("text")))
    s = table(spark, sf_dir, "documents").select("doc_id", seg.alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("s.start").alias("starts"), F.sum("s.end").alias("ends"), F.max(F.length("s.text")).alias("longest"))


SEGMENTS_SQL = rf"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_SEG}')) AS part, generate_subscripts(regexp_extract_all(text, '{_SEG}'), 1) AS i FROM documents),
o AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) - length(part) AS pos FROM p),
c AS (SELECT doc_id, regexp_replace(part, '^\s+|\s+$', '', 'g') AS clean, pos + length(part) - length(regexp_replace(part, '^\s+', '')) AS st FROM o)
SELECT doc_id, count(*) AS n, CAST(sum(st) AS BIGINT) AS starts, CAST(sum(st + length(clean)) AS BIGINT) AS ends, CAST(max(length(clean)) AS INT) AS longest FROM c WHERE clean <> '' GROUP BY doc_id"""


def text_measures(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.round(X.share_of(t, r"\p{L}"), 6).alias("letters"), F.round(X.suspicious_share(t), 6).alias("suspicious"), F.round(X.cjk_share(t), 6).alias("cjk"),
        F.length(X.compact(t)).alias("solid"), F.length(X.surface(t, False)).alias("surface"), X.occurrences(t, F.lit("the")).alias("the"), F.round(F.log1p(F.length("text")), 6).alias("log_length"),
    )


_N = lambda c: f"length(regexp_replace(text, '[{c}]', '', 'g'))"
MEASURES_SQL = rf"""SELECT doc_id, round(coalesce(CAST(length(text) - {_N(chr(92) + 'p{L}')} AS DOUBLE) / nullif(length(text), 0), 0), 6) AS letters,
  round(CASE WHEN length(text) > 0 THEN 1.0 - CAST(length(text) - {_N(chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's，。、《》：；？！“”‘’（）()' + chr(92) + '[' + chr(92) + ']【】—' + chr(92) + '-·.,:;?!/' + chr(92) * 2 + '|+*=~<>')} AS DOUBLE) / length(text) ELSE 0 END, 6) AS suspicious,
  0.0 AS cjk, length(regexp_replace(text, '\s+', '', 'g')) AS solid, length(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', '', 'g'))) AS surface,
  CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INT) AS the, round(ln(1 + length(text)), 6) AS log_length FROM documents"""


def span_tokens(spark, sf_dir):
    """Gap, order and sentence tokens of two spans a document."""
    d = table(spark, sf_dir, "documents")
    hs, ts = (F.col("doc_id") % 60).cast("int"), (F.col("n_chars") % 300).cast("int")
    he, te = hs + 5, ts + 4
    part = X.between(F.col("text"), hs, he, ts, te)
    gap = F.greatest(hs, ts) - F.least(he, te)
    return d.groupBy(X.gap_token(hs, he, ts, te).alias("gap"), X.distance_bin(gap).alias("distance"), F.when(hs <= ts, "HEAD_BEFORE_TAIL").otherwise("TAIL_BEFORE_HEAD").alias("order_token"), X.sentence_token(part).alias("sentence")).agg(F.count("*").alias("n"), F.sum(F.length(part)).alias("chars"))


TOKENS_SQL = r"""WITH s AS (SELECT text, doc_id % 60 AS hs, doc_id % 60 + 5 AS he, n_chars % 300 AS ts, n_chars % 300 + 4 AS te FROM documents),
g AS (SELECT *, greatest(hs, ts) - least(he, te) AS gap, CASE WHEN greatest(hs, ts) > least(he, te) THEN substr(text, least(he, te) + 1, greatest(hs, ts) - least(he, te)) ELSE '' END AS part FROM s)
SELECT CASE WHEN gap < 0 THEN 'SPAN_OVERLAP' WHEN gap = 0 THEN 'GAP_0' WHEN gap <= 10 THEN 'GAP_1_10' WHEN gap <= 50 THEN 'GAP_11_50' WHEN gap <= 200 THEN 'GAP_51_200' ELSE 'GAP_GT_200' END AS gap,
  CASE WHEN gap <= 5 THEN 'D00_05' WHEN gap <= 15 THEN 'D06_15' WHEN gap <= 30 THEN 'D16_30' WHEN gap <= 60 THEN 'D31_60' WHEN gap <= 100 THEN 'D61_100' WHEN gap <= 150 THEN 'D101_150' ELSE 'D151_PLUS' END AS distance,
  CASE WHEN hs <= ts THEN 'HEAD_BEFORE_TAIL' ELSE 'TAIL_BEFORE_HEAD' END AS order_token, CASE WHEN regexp_matches(part, '[。！？!?\n]') THEN 'CROSS_SENTENCE' ELSE 'SAME_SENTENCE' END AS sentence, count(*) AS n, CAST(sum(length(part)) AS BIGINT) AS chars FROM g GROUP BY ALL"""


def located_spans(spark, sf_dir):
    """Spans declared up to two places off; and the same for parts that are not there."""
    d = table(spark, sf_dir, "documents")
    part = F.when(F.col("doc_id") % 4 == 3, "@absent@").otherwise(F.substr("text", F.lit(11), F.lit(6)))
    start = (10 + F.col("doc_id") % 3).cast("int")
    at = X.located(F.col("text"), part, start, start + 6)
    return d.select("doc_id", at["start"].alias("start"), at["end"].alias("end"), X.offset_status(F.col("text"), part, start, start + 6).alias("status"))


LOCATED_SQL = """WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 3 THEN '@absent@' ELSE substr(text, 11, 6) END AS part, 10 + doc_id % 3 AS st FROM documents),
f AS (SELECT *, substr(text, st + 1, 6) = part AS exact, CASE WHEN substr(text, st + 1, 6) = part AND st + 6 <= length(text) THEN st WHEN part = '' THEN -1 ELSE instr(text, part) - 1 END AS pos FROM s)
SELECT doc_id, CAST(pos AS INT) AS start, CAST(CASE WHEN pos >= 0 THEN pos + length(part) ELSE -1 END AS INT) AS end,
  CASE WHEN exact THEN 'exact' WHEN contains(text, part) THEN 'elsewhere' ELSE 'absent' END AS status FROM f"""


def offset_integrity(spark, sf_dir):
    return located_spans(spark, sf_dir).groupBy().pivot("status", ["exact", "elsewhere", "absent"]).count()


INTEGRITY_SQL = f"SELECT count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'elsewhere') AS elsewhere, count(*) FILTER (status = 'absent') AS absent FROM ({LOCATED_SQL})"


def bigram_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.character_ngrams(F.col("text"), 2)).alias("bigrams"))


BIGRAM_SQL = r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '\s+', '', 'g'), '') AS c FROM documents)
SELECT doc_id, CAST(CASE WHEN len(c) < 2 THEN len(c) ELSE len(list_distinct([c[i] || c[i + 1] FOR i IN range(1, len(c))])) END AS INT) AS bigrams FROM t"""


def window_plan(spark, sf_dir):
    w = F.posexplode(X.windows(F.col("text"), 254, 48))
    s = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), w.alias("i", "w"))
    own = X.owned(F.col("w.start") + 100, F.col("w.start") + 110, F.col("w.start"), F.col("w.end"), 48, F.col("n"))
    return s.groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum(F.col("w.end") - F.col("w.start")).alias("covered"), F.max("w.end").alias("last_end"), F.count_if(own).alias("owned"))


WINDOW_SQL = """WITH d AS (SELECT doc_id, length(text) AS n, unnest(range(CAST(greatest(ceil((length(text) - 254) / 206.0), 0) AS INT) + 1)) * 206 AS st FROM documents WHERE length(text) > 0), w AS (SELECT *, least(st + 254, n) AS en FROM d)
SELECT doc_id, count(*) AS windows, CAST(sum(en - st) AS BIGINT) AS covered, CAST(max(en) AS INT) AS last_end,
  count(*) FILTER (st + 105 >= CASE WHEN st = 0 THEN 0 ELSE st + 24 END AND st + 105 < CASE WHEN en >= n THEN n + 1 ELSE en - 24 END) AS owned FROM w GROUP BY doc_id"""


def context_windows(spark, sf_dir):
    part = F.substr("text", (F.col("n_chars") / 2).cast("int"), F.lit(12))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.context_window(F.col("text"), part, 120)).alias("digest"))


CONTEXT_SQL = """WITH s AS (SELECT doc_id, text, substr(text, CAST(trunc(n_chars / 2.0) AS INT), 12) AS part FROM documents), f AS (SELECT *, instr(text, part) - 1 AS pos FROM s),
w AS (SELECT *, CASE WHEN pos >= 0 THEN greatest(0, pos - CAST(floor((120 - length(part)) / 2.0) AS INT)) ELSE 0 END AS st FROM f), e AS (SELECT *, least(length(text), st + 120) AS en FROM w)
SELECT doc_id, md5(CASE WHEN st > 0 THEN '…' ELSE '' END || substr(text, CAST(st + 1 AS INT), CAST(en - st AS INT)) || CASE WHEN en < length(text) THEN '…' ELSE '' END) AS digest FROM e"""


def evidence_windows(spark, sf_dir):
    """Marked windows around two spans, one near the text's beginning and one near its end."""
    d = table(spark, sf_dir, "documents")
    head, tail = F.substr("text", F.lit(5), F.lit(6)), F.substr("text", F.greatest(F.length("text") - 8, F.lit(1)), F.lit(7))
    h = X.located(F.col("text"), head, F.lit(4), F.lit(10))
    t = X.located(F.col("text"), tail, F.lit(-1), F.lit(-1))
    return d.select("doc_id", F.md5(X.evidence_window(F.col("text"), h, t, 1200)).alias("digest"))


def _marked_sql(low: str, high: str) -> str:
    """The stretch from ``low`` to ``high`` with the spans hs:he and ts:te that lie in it marked, unless they cross."""
    cut = lambda a, b: f"substr(text, CAST({a} + 1 AS INT), CAST(greatest({b} - ({a}), 0) AS INT))"
    h, t = (f"({s}s >= 0 AND {s}s >= {low} AND {s}e <= {high})" for s in "ht")
    one = lambda s, a: f"{cut(a, s + 's')} || '[{s.upper()}]' || {cut(s + 's', s + 'e')} || '[/{s.upper()}]'"
    both = f"CASE WHEN hs <= ts THEN {one('h', low)} || {one('t', 'he')} || {cut('te', high)} ELSE {one('t', low)} || {one('h', 'te')} || {cut('he', high)} END"
    return f"CASE WHEN {h} AND {t} AND hs < te AND ts < he THEN {cut(low, high)} WHEN {h} AND {t} THEN {both} WHEN {h} THEN {one('h', low)} || {cut('he', high)} WHEN {t} THEN {one('t', low)} || {cut('te', high)} ELSE {cut(low, high)} END"


EVIDENCE_SQL = f"""WITH s AS (SELECT doc_id, text, length(text) AS n, substr(text, 5, 6) AS hp, substr(text, CAST(greatest(length(text) - 8, 1) AS INT), 7) AS tp FROM documents),
p AS (SELECT *, CASE WHEN n >= 10 THEN 4 WHEN hp = '' THEN -1 ELSE instr(text, hp) - 1 END AS hs, CASE WHEN tp = '' THEN -1 ELSE instr(text, tp) - 1 END AS ts FROM s),
q AS (SELECT *, CASE WHEN hs >= 0 THEN hs + length(hp) ELSE -1 END AS he, CASE WHEN ts >= 0 THEN ts + length(tp) ELSE -1 END AS te FROM p),
r AS (SELECT *, CASE WHEN hs >= 0 AND ts >= 0 THEN least(hs, ts) WHEN hs >= 0 THEN hs ELSE ts END AS l, greatest(he, te) AS r FROM q),
w AS (SELECT *, greatest(0, l - CAST(floor((1200 - (r - l)) / 2.0) AS BIGINT)) AS a FROM r), x AS (SELECT *, least(n, r + (1200 - (r - l)) - (l - a)) AS b FROM w), y AS (SELECT *, greatest(0, b - 1200) AS c FROM x),
z AS (SELECT *, least(n, greatest(0, hs - 300) + 600) AS hb, least(n, greatest(0, ts - 300) + 600) AS tb FROM y), k AS (SELECT *, greatest(0, hb - 600) AS ha, greatest(0, tb - 600) AS ta FROM z)
SELECT doc_id, md5(CASE WHEN hs < 0 AND ts < 0 THEN substr(text, 1, 1200) WHEN r - l <= 1200 THEN {_marked_sql('c', 'b')}
  ELSE concat_ws(' [BRIDGE] ', CASE WHEN hs >= 0 THEN {_marked_sql('ha', 'hb')} END, CASE WHEN ts >= 0 THEN {_marked_sql('ta', 'tb')} END) END) AS digest FROM k"""


def omission_masks(spark, sf_dir):
    """Characters masked at equal length when evidence is left out."""
    d = table(spark, sf_dir, "documents")
    out = X.omitted(F.col("text"), X.segments(F.col("text")), F.lit(2), F.lit(6), F.lit(10), F.lit(14))
    measured = X.bound(out, lambda t: F.struct(F.length(t).alias("n"), X.count_of(t, "□").alias("masked"), F.substr(t, F.lit(3), F.lit(4)).alias("head")))
    return d.select("doc_id", measured.alias("m")).select("doc_id", "m.n", "m.masked", "m.head")


OMISSION_SQL = rf"""WITH p AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_SEG}')) AS part, generate_subscripts(regexp_extract_all(text, '{_SEG}'), 1) AS i FROM documents),
o AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) - length(part) AS pos FROM p),
c AS (SELECT doc_id, text, pos + length(part) - length(regexp_replace(part, '^\s+', '')) AS st, regexp_replace(part, '^\s+|\s+$', '', 'g') AS clean FROM o),
r AS (SELECT doc_id, min(st) AS lo, max(st + length(clean)) AS hi FROM c WHERE clean <> '' AND ((st <= 2 AND 6 <= st + length(clean)) OR (st <= 10 AND 14 <= st + length(clean))) GROUP BY doc_id),
b AS (SELECT d.doc_id, text, CAST(coalesce(lo, 0) AS INT) AS lo, CAST(coalesce(hi, least(74, length(text))) AS INT) AS hi FROM (SELECT * FROM documents) d LEFT JOIN r USING (doc_id)),
k AS (SELECT doc_id, length(text) AS n, substr(text, 3, 4) AS head, length(regexp_replace(substr(text, lo + 1, hi - lo), '\s', '', 'g')) AS whole,
  length(regexp_replace(substr(text, greatest(lo, 2) + 1, greatest(least(hi, 6) - greatest(lo, 2), 0)), '\s', '', 'g')) + length(regexp_replace(substr(text, greatest(lo, 10) + 1, greatest(least(hi, 14) - greatest(lo, 10), 0)), '\s', '', 'g')) AS kept FROM b)
SELECT doc_id, n, CAST(whole - kept AS INT) AS masked, head FROM k"""


def stable_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.stable_id(F.lit("B1"), [F.lit("B1"), F.col("p_name"), F.lit("candidateTreats"), F.col("p_brand")]).alias("id"), X.source_title(F.concat(F.lit("12. "), "p_name", F.lit(".txt")), False).alias("title"), X.source_key(F.concat("p_brand", F.lit("\\x.TXT"))).alias("path_key"))


STABLE_SQL = r"""SELECT p_partkey, 'B1-' || upper(substr(sha256('B1' || chr(9) || p_name || chr(9) || 'candidateTreats' || chr(9) || p_brand), 1, 12)) AS id, lower(regexp_replace(p_name, '[^\p{L}\p{N}]+', '', 'g')) AS title, p_brand || '/x' AS path_key FROM part"""


def salvaged_decisions(spark, sf_dir):
    """Decisions out of fenced JSON, confidences clamped, labels made normal."""
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.lit("```json\n"), "props", F.lit("\n``` thanks"))
    k = F.get_json_object(X.salvaged_json(raw), "$.k").try_cast("double")
    label = X.normal_label(F.when(F.col("event_type") == "click", " Yes ").when(F.col("event_type") == "view", "uncertain").otherwise(F.col("event_type")))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(k / 50, F.lit(0.5))))
    return e.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.round(F.sum(confidence), 6).alias("confidence"), F.round(F.avg(X.support_score(label, confidence)), 6).alias("score"))


SALVAGED_SQL = """WITH x AS (SELECT CASE event_type WHEN 'click' THEN 'supported' WHEN 'view' THEN 'plausible' ELSE 'unsupported' END AS label, greatest(0, least(1, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50, 0.5))) AS c FROM events)
SELECT label, count(*) AS n, round(sum(c), 6) AS confidence, round(avg(CASE label WHEN 'supported' THEN greatest(0.75, c) WHEN 'plausible' THEN 0.55 + 0.25 * c ELSE 0.15 * (1 - c) END), 6) AS score FROM x GROUP BY label"""


def page_split(spark, sf_dir):
    marked = F.concat(F.lit("--- 第 1 页 ---\n"), "text", F.lit("\n--- 第 12 页 ---\n"), "lang")
    p = F.explode(F.concat(X.pages(marked), X.pages(F.col("source"))))
    s = table(spark, sf_dir, "documents").select("doc_id", p.alias("p"))
    return s.groupBy(F.col("p.number").alias("number")).agg(F.count("*").alias("n"), F.sum(F.length(F.regexp_replace("p.text", r"\s", ""))).alias("solid"))


PAGE_SQL = r"""SELECT 1 AS number, count(*) AS n, CAST(sum(length(regexp_replace(text, '\s', '', 'g'))) AS BIGINT) AS solid FROM documents UNION ALL SELECT 12, count(*), CAST(sum(length(lang)) AS BIGINT) FROM documents UNION ALL SELECT NULL, count(*), CAST(sum(length(source)) AS BIGINT) FROM documents"""


def character_errors(spark, sf_dir):
    """Edit distance and error rate by brand, with its summary."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("reference"), F.concat("p_type", F.lit(" "), "p_name").alias("raw"))
    return passages.error_rates(p).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.percentile("cer", 0.5), 6).alias("median_cer"), F.sum("distance").alias("edits"))


CER_SQL = r"""WITH x AS (SELECT p_brand, regexp_replace(p_name, '\s', '', 'g') AS a, regexp_replace(p_type || ' ' || p_name, '\s', '', 'g') AS b FROM part), d AS (SELECT p_brand, levenshtein(a, b) AS d, length(a) AS n FROM x)
SELECT p_brand, count(*) AS n, round(avg(CAST(d AS DOUBLE) / n), 6) AS mean_cer, round(quantile_cont(CAST(d AS DOUBLE) / n, 0.5), 6) AS median_cer, CAST(sum(d) AS BIGINT) AS edits FROM d GROUP BY p_brand"""


def _lexicon(spark, sf_dir):
    """Frequent words of the benchmark of five letters or more, and frequent names of any length."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("text")).withColumn("label", F.when(F.col("text").rlike("^[A-Z]"), "NAME").otherwise("WORD"))
    return spans.lexicon(words, 3, 5, ("NAME",))


_LEX = """lex AS (SELECT text, label, count(*) AS n FROM (SELECT text, CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'NAME' ELSE 'WORD' END AS label FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS text FROM benchmark)) WHERE trim(text) <> '' GROUP BY ALL HAVING count(*) >= 3 AND (length(text) >= 5 OR label = 'NAME'))"""


def lexicon_matches(spark, sf_dir):
    """Every place in a document where one of the benchmark's frequent long words or names stands, inside words too."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text")
    return spans.occurrences(docs, _lexicon(spark, sf_dir))


LEXICON_SQL = f"""WITH {_LEX}, p AS (SELECT doc_id AS record_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents), g AS (SELECT record_id, i, substr(text, i, (SELECT max(length(text)) FROM lex)) AS g FROM p)
SELECT record_id, CAST(i - 1 AS INT) AS start, CAST(i - 1 + length(lex.text) AS INT) AS end, label, lex.text, n FROM g JOIN lex ON left(g, length(lex.text)) = lex.text"""


def longest_matches(spark, sf_dir):
    """The greedy choice among a document's matches, longest first, to BIO tags and back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text")
    kept = spans.without_overlap(lexicon_matches(spark, sf_dir))
    return spans.spans_from_tags(spans.bio_tags(docs, kept))


LONGEST_SQL = f"""WITH RECURSIVE m AS ({LEXICON_SQL}), c AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY "end" - start DESC, start, n DESC, label, text) AS rk FROM m),
g AS (SELECT record_id, CAST(0 AS BIGINT) AS rk, CAST([] AS STRUCT(a INT, b INT, label VARCHAR)[]) AS kept FROM c WHERE rk = 1
UNION ALL SELECT g.record_id, c.rk, CASE WHEN len([x FOR x IN kept IF x.a < c."end" AND c.start < x.b]) > 0 THEN kept ELSE list_append(kept, {{'a': c.start, 'b': c."end", 'label': c.label}}) END FROM g JOIN c ON c.record_id = g.record_id AND c.rk = g.rk + 1),
f AS (SELECT record_id, unnest(arg_max(kept, rk)) AS x FROM g GROUP BY record_id)
SELECT record_id, x.a AS start, x.b AS "end", x.label AS label FROM f"""


def retrieval(spark, sf_dir):
    """Best and second similarity of an item's lines to its first 24 characters, by character TF-IDF."""
    b = table(spark, sf_dir, "benchmark")
    seg = b.select("item_id", F.posexplode(F.split("text", r"\n")).alias("idx", "text"))
    query = b.select("item_id", F.lit(-1).alias("idx"), F.substr("text", F.lit(1), F.lit(24)).alias("text"))
    weights = passages.term_weights(seg.unionByName(query), ("item_id", "idx"), "text", 1, 2, 2)
    sims = passages.cosine(weights.where("idx >= 0"), weights.where("idx < 0").drop("idx"), ("item_id", "idx"), ("item_id",))
    out = passages.retrieval_summary(sims)
    return out.select("item_id", *(F.round(c, 6).alias(c) for c in ("best", "second", "margin")))


RETRIEVAL_SQL = r"""WITH u AS (SELECT item_id, idx - 1 AS idx, text FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM benchmark) UNION ALL SELECT item_id, -1, substr(text, 1, 24) FROM benchmark),
l AS (SELECT item_id, idx, regexp_replace(lower(text), '\s\s+', ' ', 'g') AS t FROM u), g AS (SELECT item_id, idx, substr(t, unnest(range(1, length(t) + 1)), 1) AS term FROM l UNION ALL SELECT item_id, idx, substr(t, unnest(range(1, length(t))), 2) FROM l WHERE length(t) >= 2),
tf AS (SELECT item_id, idx, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM u),
w AS (SELECT item_id, idx, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), m AS (SELECT item_id, idx, sqrt(sum(w * w)) AS m FROM w GROUP BY ALL), v AS (SELECT item_id, idx, term, w / m AS v FROM w JOIN m USING (item_id, idx)),
s AS (SELECT a.item_id, a.idx, sum(a.v * b.v) AS s FROM v a JOIN v b ON a.item_id = b.item_id AND a.term = b.term AND a.idx >= 0 AND b.idx < 0 GROUP BY ALL), o AS (SELECT item_id, list_reverse_sort(list(s)) AS s FROM s GROUP BY item_id)
SELECT item_id, round(s[1], 6) AS best, round(coalesce(s[2], 0), 6) AS second, round(s[1] - coalesce(s[2], 0), 6) AS margin FROM o"""


#: Scores of the tags of a word outside, at the beginning and inside of a name: by its first letter and its length.
CHAIN = Chain(("O", "B", "I"), {"I": -50.0}, {("O", "I"): -50.0, ("B", "I"): 0.5, ("I", "I"): 0.25}, {})


def decoded_tags(spark, sf_dir):
    """The best tags of every turn's words, a letter a word: capitals may begin a name and long words go on with it."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    score = lambda w: F.array(F.lit(1.0), F.when(w.rlike(r"^\p{Lu}"), 1.5).otherwise(0.0), F.when(F.length(w) >= 6, 1.25).otherwise(0.5))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), F.transform(words, score).alias("emissions"))
    return best_tags(turns, CHAIN, "turn_id").select("turn_id", F.array_join("tags", "").alias("tags"), "score")


DECODED_SQL = r"""WITH RECURSIVE w AS (SELECT conv_id || ':' || turn AS turn_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS t FROM conversations),
e AS (SELECT turn_id, t, g.tag, CASE g.tag WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 1.5 ELSE 0 END ELSE CASE WHEN length(word) >= 6 THEN 1.25 ELSE 0.5 END END::DOUBLE AS score FROM w, (SELECT unnest([0, 1, 2]) AS tag) g),
s AS (SELECT * FROM (VALUES (0, 0, 0.0), (0, 1, 0.0), (0, 2, -50.0), (1, 0, 0.0), (1, 1, 0.0), (1, 2, 0.5), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.25)) v(a, b, step)),
v(turn_id, t, tag, score, path) AS (SELECT turn_id, 1::BIGINT, tag, (score + CASE WHEN tag = 2 THEN -50.0 ELSE 0.0 END)::DOUBLE, substr('OBI', tag + 1, 1) FROM e WHERE t = 1
  UNION ALL SELECT v.turn_id, v.t + 1, s.b, (max(v.score + s.step) + any_value(e.score))::DOUBLE, arg_max(v.path, (v.score + s.step) * 1000 - s.a) || substr('OBI', s.b + 1, 1)
  FROM v JOIN s ON s.a = v.tag JOIN e ON e.turn_id = v.turn_id AND e.t = v.t + 1 AND e.tag = s.b GROUP BY v.turn_id, v.t, s.b),
n AS (SELECT turn_id, max(t) AS n FROM w GROUP BY turn_id), b AS (SELECT v.turn_id, max(score) AS score, arg_max(path, score * 1000 - tag) AS tags FROM v JOIN n ON n.turn_id = v.turn_id AND n.n = v.t GROUP BY v.turn_id)
SELECT c.conv_id || ':' || c.turn AS turn_id, coalesce(b.tags, '') AS tags, b.score FROM conversations c LEFT JOIN b ON b.turn_id = c.conv_id || ':' || c.turn"""


def donors(spark, sf_dir):
    g = gold(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", "gold")
    return passages.closest_donor(g.where("gold = 'SUPPORTED'"), g.where("gold <> 'SUPPORTED'"), (("lang", "source"), ("source",), ("lang",)), "n_chars", "doc_id")


DONORS_SQL = f"""WITH g AS ({GOLD_SQL}), i AS (SELECT * FROM g WHERE gold = 'SUPPORTED'), d AS (SELECT * FROM g WHERE gold <> 'SUPPORTED'),
p AS (SELECT i.doc_id, d.doc_id AS donor, CASE WHEN i.lang = d.lang AND i.source = d.source THEN 1 WHEN i.source = d.source THEN 2 ELSE 3 END AS tier, -abs(i.n_chars - d.n_chars) AS score FROM i JOIN d ON i.source = d.source OR i.lang = d.lang)
SELECT doc_id, donor, CAST(tier AS INT) AS tier, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, score DESC, donor) AS rn FROM p) WHERE rn = 1"""


def donors_by_score(spark, sf_dir):
    """For each supported document, the other one of the best score: of its source and language, else of its source, else of all."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 1, 6).alias("head_text"), F.col("source").alias("tail_text"))
    g = gold(spark, sf_dir).select("doc_id", "lang", "source", "gold").join(texts, "doc_id")
    out = best_donor(g.where("gold = 'SUPPORTED'"), g.where("gold <> 'SUPPORTED'"), (("lang", "source"), ("source",), ()), "doc_id")
    return out.withColumn("score", F.round("score", 9))


DONOR_SCORE_SQL = rf"""WITH g AS (SELECT doc_id, x.lang, x.source, gold, text, left(text, 6) AS head, x.source AS tail, length(text) AS n FROM ({GOLD_SQL}) x JOIN documents USING (doc_id)),
c AS (SELECT doc_id, unnest(s) AS ch, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '[\s\x0B\x{{3000}}\x{{00A0}}]+', '', 'g'), '') AS s FROM g)),
b AS (SELECT DISTINCT doc_id, ch || nxt AS gram FROM (SELECT doc_id, ch, lead(ch) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM c) WHERE nxt IS NOT NULL UNION SELECT doc_id, min(ch) FROM c GROUP BY doc_id HAVING count(*) = 1 AND min(ch) <> ''),
m AS (SELECT doc_id, count(*) AS m FROM b GROUP BY doc_id),
t AS (SELECT i.doc_id, d.doc_id AS donor, CASE WHEN i.lang = d.lang AND i.source = d.source THEN 1 WHEN i.source = d.source THEN 2 ELSE 3 END AS tier, i.n, d.n AS dn, contains(d.text, i.head) OR contains(d.text, i.tail) AS ends
  FROM g i JOIN g d ON i.gold = 'SUPPORTED' AND d.gold <> 'SUPPORTED'),
f AS (SELECT * FROM t QUALIFY tier = min(tier) OVER (PARTITION BY doc_id)),
s AS (SELECT f.doc_id, f.donor, count(*) AS common FROM f JOIN b x ON x.doc_id = f.doc_id JOIN b y ON y.doc_id = f.donor AND y.gram = x.gram GROUP BY ALL),
r AS (SELECT f.doc_id, f.donor, tier, round(coalesce(common / CAST(coalesce(a.m, 0) + coalesce(z.m, 0) - common AS DOUBLE), 0) + 0.2 * exp(-abs(dn - greatest(f.n, 1)) / CAST(greatest(f.n, 1) AS DOUBLE)) + CASE WHEN ends THEN 0.15 ELSE 0 END, 12) AS score
  FROM f LEFT JOIN s USING (doc_id, donor) LEFT JOIN m a ON a.doc_id = f.doc_id LEFT JOIN m z ON z.doc_id = f.donor)
SELECT doc_id, donor, CAST(tier AS INT) AS tier, round(score, 9) AS score FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, donor) = 1"""


def _mentions(spark, sf_dir):
    return gold(spark, sf_dir).select("doc_id", F.col("gold").alias("label"), F.concat(F.lit(" "), F.upper("lang"), F.lit("。")).alias("head_text"), F.when(F.col("doc_id") % 3 == 0, "A").otherwise("B").alias("head_type"), F.col("source").alias("tail_text"), F.when(F.col("doc_id") % 2 == 0, "A").otherwise("C").alias("tail_type"))


_MENTION = f"m AS (SELECT doc_id, gold AS label, lang AS head, CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'B' END AS head_type, source AS tail, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'C' END AS tail_type FROM ({GOLD_SQL})), lx AS (SELECT surface, type, count(*) AS n, count(*) FILTER (role = 'h') AS heads, count(*) FILTER (role = 't') AS tails FROM (SELECT head AS surface, head_type AS type, 'h' AS role FROM m WHERE label <> 'ENTITY_OR_TYPE_ERROR' UNION ALL SELECT tail, tail_type, 't' FROM m WHERE label <> 'ENTITY_OR_TYPE_ERROR') GROUP BY ALL)"


def identity_lexicon(spark, sf_dir):
    return passages.identity_lexicon(_mentions(spark, sf_dir))


IDENTITY_SQL = f"WITH {_MENTION} SELECT * FROM lx"


def identity_features(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    f = passages.identity_features(m, passages.identity_lexicon(m), "tail")
    return f.select("doc_id", "tail_seen", "tail_count", "tail_expected", "tail_other", F.round("tail_expected_share", 6).alias("expected_share"), F.round("tail_dominant_share", 6).alias("dominant_share"), "tail_only_other", "tail_single")


IDENTITY_F_SQL = f"""WITH {_MENTION}, s AS (SELECT surface, sum(n) AS total, max(n) AS dominant FROM lx GROUP BY surface)
SELECT m.doc_id, CAST(coalesce(total, 0) > 0 AS INT) AS tail_seen, CAST(coalesce(total, 0) AS BIGINT) AS tail_count, coalesce(lx.n, 0) AS tail_expected, CAST(coalesce(total, 0) - coalesce(lx.n, 0) AS BIGINT) AS tail_other,
  round(coalesce(lx.n, 0) / greatest(coalesce(total, 0), 1), 6) AS expected_share, round(coalesce(dominant, 0) / greatest(coalesce(total, 0), 1), 6) AS dominant_share,
  CAST(coalesce(total, 0) > 0 AND coalesce(lx.n, 0) = 0 AS INT) AS tail_only_other, CAST(length(m.tail) = 1 AS INT) AS tail_single FROM m LEFT JOIN s ON m.tail = s.surface LEFT JOIN lx ON m.tail = lx.surface AND m.tail_type = lx.type"""


def majorities(spark, sf_dir):
    g = gold(spark, sf_dir)
    whole = passages.majority(g, None, "gold").select(F.lit("*").alias("field"), "majority", "n")
    return whole.unionByName(passages.majority(g, "source", "gold").select(F.col("source").alias("field"), "majority", "n"))


MAJORITY_SQL = f"""WITH g AS ({GOLD_SQL}), c AS (SELECT source AS field, gold, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT '*', gold, count(*) FROM g GROUP BY gold)
SELECT field, gold AS majority, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, gold) AS rn FROM c) WHERE rn = 1"""


def vocabulary(spark, sf_dir):
    return passages.vocabulary(table(spark, sf_dir, "part"), "p_type")


VOCABULARY_SQL = "SELECT p_type, n, CAST(row_number() OVER (ORDER BY n DESC, p_type) AS INT) AS index FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)"


def crosswalk_summary(spark, sf_dir):
    """Many-to-one crosswalk of customers to nations and the summary of each nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal", "c_custkey")
    joined = passages.many_to_one(c, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "k")
    from loamwork.operators.study import describe

    d = describe(joined, "c_acctbal", "c_custkey", ("n_name",))
    return d.select("n_name", "n", "n_keys", *(F.round(c, 6).alias(c) for c in ("mean", "median", "q1", "q3", "least", "most")))


CROSSWALK_SQL = """SELECT n_name, count(c_acctbal) AS n, count(DISTINCT c_custkey) AS n_keys, round(avg(c_acctbal), 6) AS mean, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.25), 6) AS q1,
  round(quantile_cont(c_acctbal, 0.75), 6) AS q3, round(min(c_acctbal), 6) AS least, round(max(c_acctbal), 6) AS most FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""


def coverage_counters(spark, sf_dir):
    """Counts by (lang, gold), by lang, and in all."""
    return spark.sql("SELECT lang, gold, CAST(grouping_id() AS INT) AS level, count(*) AS n, count(DISTINCT source) AS sources FROM {rows} GROUP BY GROUPING SETS ((lang, gold), (lang), ())", rows=gold(spark, sf_dir))


COUNTERS_SQL = f"WITH g AS ({GOLD_SQL}) SELECT lang, gold, CAST(grouping(lang, gold) AS INT) AS level, count(*) AS n, count(DISTINCT source) AS sources FROM g GROUP BY GROUPING SETS ((lang, gold), (lang), ())"


def payload_long(spark, sf_dir):
    """Nested predictions to rows (item, system), probabilities from maps to columns."""
    g = gold(spark, sf_dir)
    systems = F.create_map(F.lit("first"), F.struct(F.col("pred").alias("label"), F.col("probs").alias("p")), F.lit("second"), F.struct(F.col("gold").alias("label"), F.reverse("probs").alias("p")))
    long = g.select("doc_id", F.explode(systems).alias("system", "v"))
    return long.select("doc_id", "system", F.col("v.label").alias("label"), *(F.round(F.get("v.p", F.lit(i)), 6).alias(f"p{i + 1}") for i in range(4)))


PAYLOAD_SQL = f"WITH g AS ({GOLD_SQL}) SELECT doc_id, 'first' AS system, pred AS label, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4 FROM g UNION ALL SELECT doc_id, 'second', gold, round(p4, 6), round(p3, 6), round(p2, 6), round(p1, 6) FROM g"


def seed_means(spark, sf_dir):
    """Mean vector of three seeds and the check against the stored mean."""
    from loamwork.functions import vectors as V

    g = gold(spark, sf_dir)
    seeds = F.array("probs", V.tempered(F.col("probs"), 2.0), F.reverse("probs"))
    m = g.select("doc_id", V.mean_of(seeds).alias("m"))
    return m.select("doc_id", *(F.round(F.get("m", F.lit(i)), 6).alias(f"m{i + 1}") for i in range(4)), (F.abs(V.total(F.col("m")) - 1) <= 1e-10).alias("sums_to_one"))


_Q = lambda i: f"sqrt(p{i}) / (sqrt(p1) + sqrt(p2) + sqrt(p3) + sqrt(p4))"
SEED_SQL = f"SELECT doc_id, {', '.join(f'round((p{i} + {_Q(i)} + p{5 - i}) / 3, 6) AS m{i}' for i in range(1, 5))}, true AS sums_to_one FROM ({GOLD_SQL})"


def intervention_effects(spark, sf_dir):
    """Decisions that change between two systems and the mean absolute change of probabilities, by language."""
    g = gold(spark, sf_dir)
    change = F.aggregate(F.zip_with("probs", F.reverse("probs"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / 4
    return g.groupBy("lang").agg(F.count_if(F.col("gold") != F.col("pred")).alias("changed"), F.round(F.avg(change), 6).alias("mean_change"))


EFFECTS_SQL = f"SELECT lang, count(*) FILTER (gold <> pred) AS changed, round(avg((2 * abs(p1 - p4) + 2 * abs(p2 - p3)) / 4), 6) AS mean_change FROM ({GOLD_SQL}) GROUP BY lang"


def key_sets(spark, sf_dir):
    """Union, intersection and differences of two sets of keys, counted."""
    o = table(spark, sf_dir, "orders")
    a, b = o.where("o_orderpriority LIKE '1%'").select("o_custkey"), o.where("o_totalprice > 150000").select("o_custkey")
    sets = {"both": a.intersect(b), "first": a.subtract(b), "second": b.subtract(a), "any": a.union(b).distinct(), "extra": a.exceptAll(b)}
    out = None
    for name, s in sets.items():
        part = s.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


SETS_SQL = """WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 150000)
SELECT 'both' AS name, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'second', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)
UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'extra', count(*) FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)"""


def long_scores(spark, sf_dir):
    """Wide columns to long and flat arrays to columns."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return p.unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "value").groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


LONG_SQL = "SELECT 'p_size' AS name, count(*) AS n, round(CAST(sum(p_size) AS DOUBLE), 2) AS total FROM part UNION ALL SELECT 'p_retailprice', count(*), round(sum(p_retailprice), 2) FROM part"

QUERIES = {
    "text_segments": text_segments, "text_measures": text_measures, "span_tokens": span_tokens, "located_spans": located_spans, "offset_integrity": offset_integrity, "bigram_sets": bigram_sets,
    "window_plan": window_plan, "context_windows": context_windows, "evidence_windows": evidence_windows, "omission_masks": omission_masks, "stable_ids": stable_ids, "salvaged_decisions": salvaged_decisions,
    "page_split": page_split, "character_errors": character_errors, "lexicon_matches": lexicon_matches, "longest_matches": longest_matches, "retrieval": retrieval, "donors": donors, "decoded_tags": decoded_tags, "donors_by_score": donors_by_score,
    "identity_lexicon": identity_lexicon, "identity_features": identity_features, "majorities": majorities, "vocabulary": vocabulary, "crosswalk_summary": crosswalk_summary, "coverage_counters": coverage_counters,
    "payload_long": payload_long, "seed_means": seed_means, "intervention_effects": intervention_effects, "key_sets": key_sets, "long_scores": long_scores,
}
ORACLES = {
    "text_segments": SEGMENTS_SQL, "text_measures": MEASURES_SQL, "span_tokens": TOKENS_SQL, "located_spans": LOCATED_SQL, "offset_integrity": INTEGRITY_SQL, "bigram_sets": BIGRAM_SQL,
    "window_plan": WINDOW_SQL, "context_windows": CONTEXT_SQL, "evidence_windows": EVIDENCE_SQL, "longest_matches": LONGEST_SQL, "omission_masks": OMISSION_SQL, "stable_ids": STABLE_SQL, "salvaged_decisions": SALVAGED_SQL, "page_split": PAGE_SQL,
    "character_errors": CER_SQL, "lexicon_matches": LEXICON_SQL, "retrieval": RETRIEVAL_SQL, "donors": DONORS_SQL, "decoded_tags": DECODED_SQL, "donors_by_score": DONOR_SCORE_SQL, "identity_lexicon": IDENTITY_SQL, "identity_features": IDENTITY_F_SQL,
    "majorities": MAJORITY_SQL, "vocabulary": VOCABULARY_SQL, "crosswalk_summary": CROSSWALK_SQL, "coverage_counters": COUNTERS_SQL, "payload_long": PAYLOAD_SQL, "seed_means": SEED_SQL,
    "intervention_effects": EFFECTS_SQL, "key_sets": SETS_SQL, "long_scores": LONG_SQL,
}
