"""One query per operator over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.llm import brown, chat, exact_dedup, html, licenses, merkle, mixing, ngram_join, pieces, quality, shards, spelling, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(plan: Callable[[SparkSession, str], DataFrame]):
    QUERIES[plan.__name__] = plan
    return plan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates by Golomb-coded fingerprint exchange."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op9_golomb_exact_dedup"] = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bytes
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY bytes) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept,
       sha256(bytes) AS text_sha256
FROM rows
WINDOW w AS (PARTITION BY bytes ORDER BY points DESC, doc_id NULLS LAST)
"""


@query
def op5_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document when sources are mixed to capped targets."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes")


def _sainte_lague_sql(parties: str, group: str, votes: str, order: str) -> str:
    """Highest quotients with every quotient up to the upper bound, none granted beforehand."""
    over = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, {order}" if group else order
    return f"""
  SELECT {keys}, count(*) AS won FROM (
    SELECT *, row_number() OVER ({over} ORDER BY {votes} / (2 * k + 1) DESC, {order}, k) AS place
    FROM (SELECT *, unnest(range(0, CAST(floor({votes} * (seats + n / 2.0) / total + 0.5) AS BIGINT) + 1)) AS k
          FROM (SELECT *, sum({votes}) OVER ({over}) AS total, count(*) OVER ({over}) AS n FROM {parties}) WHERE {votes} > 0)
  ) WHERE place <= seats GROUP BY {keys}"""


ORACLES["op5_sainte_lague_mix"] = rf"""
WITH sizes AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS nameless,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
),
per_source AS (
  SELECT source, nameless, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
         row_number() OVER (ORDER BY nameless, source) AS rank
  FROM sizes GROUP BY source, nameless
),
weighed AS (
  SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, 1.5 * sum(source_size) OVER () AS goal FROM per_source
),
levels AS (
  SELECT *, (CAST(goal AS DOUBLE) - coalesce(sum(2 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (
  SELECT *, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * weight) AS target,
         CAST(floor(CAST(goal AS DOUBLE) / {mixing.BLOCK_WORDS} + 0.5) AS BIGINT) AS seats,
         greatest(1, CAST(ceil((source_size + 64 * n_docs) / {mixing.SHARD_LOAD}) AS BIGINT)) AS n_shards
  FROM levels
),
source_won AS ({_sainte_lague_sql("targets", "", "target", "rank")}),
sharded AS (
  SELECT s.*, t.source_size, t.target, coalesce(w.won, 0) AS source_quota,
         CAST('0x' || substr(md5('0/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % n_shards AS shard
  FROM sizes s JOIN targets t USING (source, nameless) LEFT JOIN source_won w USING (rank)
),
shards AS (
  SELECT source, nameless, source || nameless AS name, shard, CAST(sum(size) AS BIGINT) AS words, max(source_quota) AS seats
  FROM sharded GROUP BY source, nameless, shard
),
shard_won AS ({_sainte_lague_sql("shards", "name", "words", "shard")}),
quotas AS (
  SELECT source, nameless, shard, words, blocks, least(coalesce(won, 0), 2 * blocks) AS quota,
         CAST('0x' || substr(md5('blocks/0/' || source || '/' || shard), 1, 8) AS BIGINT) AS shift
  FROM (SELECT *, greatest(1, CAST(floor(words / {mixing.BLOCK_WORDS} + 0.5) AS BIGINT)) AS blocks FROM shards)
  LEFT JOIN shard_won USING (name, shard)
),
placed AS (
  SELECT *, "end" - size AS begin, quota // blocks AS passes, quota % blocks AS extra
  FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY source, nameless, shard
          ORDER BY md5('order/0/' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM sharded)
  JOIN quotas USING (source, nameless, shard)
)
SELECT doc_id, size, source_size, target,
       passes * size + CASE WHEN size = 0 OR extra = 0 THEN 0 ELSE CAST(coalesce(list_sum(list_transform(
         list_filter(range(((begin + 1) * blocks - 1) // words, ("end" * blocks - 1) // words + 1), lambda j: (j * {mixing.STRIDE} + shift) % blocks < extra),
         lambda j: least("end", (j + 1) * words // blocks) - greatest(begin, j * words // blocks))), 0) AS BIGINT) END AS taken,
       CASE WHEN size > 0 THEN passes ELSE 0 END AS passes
FROM placed
"""


@query
def op6_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict by rules whose cutoffs are proven on the labelled documents."""
    judged = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.drop("rejected_by")


def _quality_sql(risk: float = 0.005, error: float = 0.05) -> str:
    cases = ", ".join(
        f"('{rule}', '{count}', {weight}, '{compared}', {c})"
        for rule, (count, weight, compared, cutoffs) in quality.RULES.items() for c in cutoffs
    )
    value = lambda column: "CASE " + column + " " + " ".join(f"WHEN '{c}' THEN {c}" for c in ("n_symbols", "n_dup_lines", "n_repeat_words", "word_chars", "n_lines", "n_words")) + " END"
    return rf"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
spots AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS found
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM split))
  WHERE found > 1
),
repeats AS (SELECT rid, CAST(sum(least(3, i - coalesce(before, -3))) AS BIGINT) AS n_repeat_words FROM spots GROUP BY rid),
measured AS (
  SELECT rid, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (rid)
),
cases(rule, counted, weight, compared, cutoff) AS (VALUES {cases}),
labelled AS (
  SELECT m.*, good FROM measured m JOIN
    (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
),
tests AS (
  SELECT coalesce(lang, '') AS stratum, rule, cutoff, count(*) FILTER (WHERE good = 1) AS n,
         count(*) FILTER (WHERE good = 1 AND weight * ({value("counted")}) > cutoff * ({value("compared")})) AS k,
         count(*) FILTER (WHERE good = 0 AND weight * ({value("counted")}) > cutoff * ({value("compared")})) AS bad
  FROM labelled, cases GROUP BY ALL
),
proven AS (
  SELECT *, max(CASE WHEN k > n * {risk} OR n = 0 THEN 1 ELSE list_sum(list_transform(range(0, k + 1),
           lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END)
         OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS tail
  FROM tests
),
chosen AS (
  SELECT stratum, rule, cutoff FROM proven
  WHERE tail <= {error} / ({len(quality.RULES)} * (SELECT count(DISTINCT stratum) FROM tests)) AND bad - {quality.PRICE} * k > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - {quality.PRICE} * k DESC, cutoff DESC) = 1
),
fired AS (
  SELECT DISTINCT rid FROM measured m JOIN chosen c ON coalesce(m.lang, '') = c.stratum JOIN cases USING (rule, cutoff)
  WHERE weight * ({value("counted")}) > cutoff * ({value("compared")})
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.rid IS NULL AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured) m LEFT JOIN fired f ON m.rid = f.rid
"""


ORACLES["op6_risk_controlled_quality"] = _quality_sql()


@query
def op4_diagonal_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every text, by diagonal voting."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def _licenses_sql() -> str:
    named = [(label, text, True) for label, text in licenses.PHRASES.items()] + [(label, text, False) for label, text in licenses.TEMPLATES]
    values = ", ".join(f"({i}, '{label}', {phrase}, '{text.lower()}')" for i, (label, text, phrase) in enumerate(named))
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
templates AS (
  SELECT template, label, phrase, regexp_extract_all(notice, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (VALUES {values}) v(template, label, phrase, notice)
),
positions AS (
  SELECT template, label, phrase, len(words) - 1 AS grams, i AS place, words[i] AS w, words[i + 1] AS nxt
  FROM (SELECT *, unnest(range(1, len(words))) AS i FROM templates)
),
hits AS (
  SELECT t.rid, template, label, phrase, grams, place, pos, pos - place AS diagonal
  FROM (SELECT rid, i AS pos, words[i] AS w, words[i + 1] AS nxt FROM (SELECT rid, words, unnest(range(1, len(words))) AS i FROM texts)) t
  JOIN positions USING (w, nxt)
),
diagonals AS (
  SELECT rid, template, label, phrase, grams, diagonal, count(DISTINCT place) AS covered, min(pos) AS first, max(pos) AS last
  FROM hits GROUP BY ALL
),
marked AS (
  SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span
  FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {licenses.BAND} THEN 1 ELSE 0 END AS new
        FROM diagonals WHERE NOT phrase AND covered >= least({licenses.VOTES}, grams))
),
spans AS (
  SELECT rid, label, phrase, diagonal AS start, 1.0::DOUBLE AS score FROM diagonals WHERE phrase AND covered = grams
  UNION ALL
  SELECT rid, label, phrase, min(pos), count(DISTINCT place) / grams
  FROM marked m JOIN hits h USING (rid, template, label, phrase, grams, diagonal)
  GROUP BY rid, template, label, phrase, grams, span
  HAVING count(DISTINCT place) / grams >= {licenses.COVERAGE} AND max(pos) - min(pos) <= 2 * (grams + 1)
),
found AS (
  SELECT rid, count(*) FILTER (WHERE phrase) AS n_base, min(start) FILTER (WHERE phrase) AS first_word, max(start) FILTER (WHERE phrase) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase), '') AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM spans GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM texts LEFT JOIN found USING (rid)
"""


ORACLES["op4_diagonal_license_scan"] = _licenses_sql()


@query
def op2_typed_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and of one that quotes control strings."""
    quoted = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(quoted).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_turns(chat.text_parts(turns)))


_ESCAPED = r"""regexp_replace(replace({0}, '\', '\\'), '(<)(\|[a-z_]+\|>|/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"""

ORACLES["op2_typed_chat_format"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL
  SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS attachments, CAST(0 AS BIGINT) AS extra_tokens
FROM turns GROUP BY conv_id
"""


@query
def op8_consensus_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the elected paths of its host."""
    texts = html.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars", "by_consensus")


@query
def op3_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles overlap by 90 % of their union."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by what a toxic dictionary saves when its windows are compressed."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_brown_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under Brown class bigrams and under add-one unigrams."""
    return brown.score(table(spark, sf_dir, "documents"))


@query
def op7_gumbel_piece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sampled piece segmentations of every whole text, with inclusion scores."""
    return pieces.sampled_pieces(table(spark, sf_dir, "documents"))


@query
def op12_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes; equal texts stay together, largest groups first."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
    )
    sharded = shards.lpt_shards(rows, F.col("digest"), F.col("size"), 8, [F.col("doc_id")])
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op13_lag_lead_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents by source, and what tampered texts fold to."""
    columns = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1, F.lit(True))
    tampered = F.when(odd, F.col("text")).otherwise(F.regexp_replace("text", "\n", ""))
    leaves = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("key"), merkle.leaf(*columns(F.col("text"))).alias("node"), merkle.leaf(*columns(tampered)).alias("found")
    )
    proven = merkle.manifest(leaves, [F.col("doc_id")])
    folded = merkle.fold(F.col("found"), F.col("steps"))
    return proven.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", merkle.digest(merkle.siblings(F.col("steps"))).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op11_reduced_alphabet_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words, the words one edit away and the spelling each one is a variant of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of UTF-8 text, byte by byte; the table follows from the polynomial."""
    entries = []
    for entry in range(256):
        for _ in range(8):
            entry = entry >> 1 ^ (0xEDB88320 if entry & 1 else 0)
        entries.append(entry)
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda pair: CAST('0x' || pair AS BIGINT))"
    step = f"xor(crc >> 8, {entries}[CAST(xor(crc, octet) & 255 AS BIGINT) + 1])"
    return f"xor(list_reduce({octets}, lambda crc, octet: {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


ORACLES["op12_lpt_shards"] = rf"""
WITH RECURSIVE rows AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS digest, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         {_crc32_sql("coalesce(text, '')")} AS text_crc32
  FROM documents
),
groups AS (
  SELECT digest, weight, row_number() OVER (ORDER BY weight DESC, digest) AS turn, row_number() OVER (PARTITION BY weight ORDER BY digest) AS place
  FROM (SELECT digest, CAST(sum(size) AS BIGINT) AS weight FROM rows GROUP BY digest)
),
dealt AS (
  SELECT CAST(0 AS BIGINT) AS turn, list_transform(range(8), lambda s: CAST(0 AS BIGINT)) AS loads, CAST(NULL AS INT) AS shard
  UNION ALL
  SELECT g.turn, list_transform(range(8), lambda s: loads[s + 1] + CASE WHEN s + 1 = list_position(loads, list_min(loads)) THEN weight ELSE 0 END),
         CAST(list_position(loads, list_min(loads)) - 1 AS INT)
  FROM dealt JOIN groups g ON g.turn = dealt.turn + 1
),
taken AS (
  SELECT weight, shard, row_number() OVER (PARTITION BY weight ORDER BY shard) AS place FROM dealt JOIN groups USING (turn)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, digest) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM rows JOIN groups USING (digest) JOIN taken USING (weight, place)
"""


def _merkle_sql() -> str:
    field = lambda column: f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def tree(name: str, first: str) -> str:
        """Levels of a tree per key as lists, the siblings of every node, and nothing above one node."""
        return f"""
{name}_levels AS (
  {first}
  UNION ALL
  SELECT key, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))
  FROM {name}_levels WHERE len(nodes) > 1
)"""

    sides = lambda nodes, at: f"array_to_string(list_slice({nodes}, {at} - {at} % 3 + 1, {at}), '') AS lhs, array_to_string(list_slice({nodes}, {at} + 2, {at} - {at} % 3 + 3), '') AS rhs"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, {leaf("text")} AS leaf, {leaf("tampered")} AS found
  FROM (SELECT *, CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents)
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY key, doc_id NULLS FIRST, leaf, found) AS rid,
         row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS pos
  FROM leaves
),
{tree("low", "SELECT key, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY key")},
subroots AS (
  SELECT key, nodes[1] AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos FROM low_levels WHERE len(nodes) = 1
),
{tree("high", "SELECT 0 AS key, 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots HAVING count(*) > 0")},
steps AS (
  SELECT rid, level, {sides("nodes", "place")}
  FROM (SELECT rid, level, nodes, CAST(pos AS BIGINT) // CAST(pow(3, level) AS BIGINT) AS place FROM placed JOIN low_levels USING (key) WHERE len(nodes) > 1)
  UNION ALL
  SELECT rid, 1000 + level, {sides("nodes", "place")}
  FROM (SELECT rid, level, nodes, CAST(s.pos AS BIGINT) // CAST(pow(3, level) AS BIGINT) AS place
        FROM placed JOIN subroots s USING (key), high_levels WHERE len(nodes) > 1)
),
ordered AS (SELECT rid, lhs, rhs, row_number() OVER (PARTITION BY rid ORDER BY level) AS turn FROM steps),
folded AS (
  SELECT rid, CAST(0 AS BIGINT) AS turn, found AS node FROM placed
  UNION ALL
  SELECT o.rid, o.turn, sha256(lhs || node || rhs) FROM folded f JOIN ordered o ON o.rid = f.rid AND o.turn = f.turn + 1
),
proofs AS (SELECT rid, sha256(string_agg(lhs || rhs, '' ORDER BY turn)) AS proof_sha256 FROM ordered GROUP BY rid)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (key)
  JOIN (SELECT rid, arg_max(node, turn) AS folded_root FROM folded GROUP BY rid) USING (rid)
  LEFT JOIN proofs USING (rid), (SELECT nodes[1] AS root FROM high_levels WHERE len(nodes) = 1)
"""


ORACLES["op13_lag_lead_merkle"] = _merkle_sql()


ORACLES["op11_reduced_alphabet_variants"] = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {spelling.MIN_LETTERS} GROUP BY doc_id, run
),
hashed AS (SELECT *, {_crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {spelling.MIN_LETTERS} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}
),
holes AS (SELECT DISTINCT word, n, i, left(word, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT word, n, head || tail AS rest FROM holes),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b USING (i, head, tail) WHERE a.word <> b.word
  UNION ALL
  SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON w.word = s.rest
  UNION ALL
  SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON w.word = s.rest
),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
chains AS (
  SELECT word, word AS root FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c ON c.word = f.word JOIN forms last ON last.word = c.root WHERE last.form IS NULL
"""
