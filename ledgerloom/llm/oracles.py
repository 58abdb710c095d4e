"""DuckDB SQL for the operators of this subpackage that SQL can express.

Each statement is written from the contract of its query, on DuckDB's own functions, so that both
sides share nothing but the parameters.
"""

from __future__ import annotations

from ledgerloom.llm import chat_format, mixing, quality_rules, sharding

def op4_sql() -> str:
    n, size = len(sharding.SHARDS), sharding.TABLE_SIZE
    return f"""
WITH RECURSIVE shard AS (
  SELECT i, printf('shard-%03d', i) AS name,
    ('0x' || substr(md5(printf('shard-%03d', i)), 1, 8))::BIGINT % {size} AS off,
    ('0x' || substr(md5(printf('shard-%03d', i)), 9, 8))::BIGINT % {size - 1} + 1 AS skip
  FROM range({n}) r(i)
), pref AS (
  SELECT list(off ORDER BY i) AS off, list(skip ORDER BY i) AS skip FROM shard
), fill(t, slot, taken, next) AS (
  SELECT 0::BIGINT, off[1], [off[1]], list_concat([1], list_transform(range({n - 1}), lambda x: 0)) FROM pref
  UNION ALL
  SELECT t + 1, s, list_append(taken, s), list_concat(next[1:i], [j + 1], next[i+2:])
  FROM (
    SELECT t, i, taken, next, j, (off[i + 1] + j * skip[i + 1]) % {size} AS s
    FROM (
      SELECT t, i, taken, next, off, skip,
        coalesce(
          list_filter(range(next[i + 1], least(next[i + 1] + 32, {size})), lambda j: NOT list_contains(taken, (off[i + 1] + j * skip[i + 1]) % {size}))[1],
          list_filter(range(next[i + 1], {size}), lambda j: NOT list_contains(taken, (off[i + 1] + j * skip[i + 1]) % {size}))[1]) AS j
      FROM (SELECT t, (t + 1) % {n} AS i, taken, next, off, skip FROM fill, pref WHERE t + 1 < {size})
    )
  )
), owner AS (SELECT slot, t % {n} AS i FROM fill)
SELECT d.doc_id, h.slot::INTEGER AS slot, printf('shard-%03d', o.i) AS shard
FROM documents d, LATERAL (SELECT ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT % {size} AS slot) h
JOIN owner o ON o.slot = h.slot
"""


def op8_sql() -> str:
    t = chat_format.DEFAULT
    controls = "|".join("".join("\\" + c if c in "[]()|*+?.^$\\" else c for c in x) for x in t.controls())
    ends = " ".join(
        f"WHEN '{role}' THEN {len(turn.open) + len(turn.close) + 2}" for role, turn in t.turns.items()
    )
    generic = len(t.other.open) + len(t.other.close) + 3
    states = {}
    for s, row in t.machine.items():
        for r, to in row.items():
            states.setdefault(r, set()).add(to)
    # with this machine a state is known by the last role alone, so the order is valid if every
    # pair of neighbours is allowed
    pairs = sorted({("start", r) for r in t.machine["start"]} | {
        (a, b) for a, tos in states.items() for to in tos for b in t.machine.get(to, {})
    })
    allowed = ", ".join(f"'{a}>{b}'" for a, b in pairs)
    last = ", ".join(f"'{r}'" for r, tos in states.items() if tos <= set(t.accepting))
    found = r"(\\*)(" + controls + ")"
    put = r"\1\\\2"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, coalesce(lag(role) OVER w, 'start') || '>' || role AS pair,
    lead(role) OVER w IS NULL AS is_last,
    length(regexp_replace(text, '{found}', '{put}', 'g'))
      + CASE role {ends} ELSE {generic} + length(to_base64(role::BLOB)) END AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(pair IN ({allowed}) AND (NOT is_last OR role IN ({last}))) AS valid_order
FROM p GROUP BY conv_id
"""


def op9_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    limits = {r.name: r for r in quality_rules.RULES}
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), win AS (
  SELECT r, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: {{'i': i, 'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}})) AS x FROM d
), grams AS (
  SELECT r, list(x.i) AS ats FROM win GROUP BY r, x.a, x.b, x.c HAVING count(*) > 1
), cover AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, unnest(ats) AS i FROM grams), (VALUES (0), (1), (2)) v(k) GROUP BY r
), line AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop
  FROM d LEFT JOIN cover USING (r) LEFT JOIN line USING (r)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed
    AND word_chars::DOUBLE / n_words BETWEEN {limits["mean_word"].low} AND {limits["mean_word"].high}
    AND n_symbols::DOUBLE / n_words <= {limits["symbols"].high}
    AND n_stop::DOUBLE / n_words >= {limits["stop_words"].low}
    AND n_dup_lines::DOUBLE / n_lines <= {limits["duplicate_lines"].high} AS kept
FROM v
"""


def op10_sql() -> str:
    steps, blocks = mixing.STEPS, 2**32 // mixing.BLOCKS

    def hashed(text: str) -> str:
        return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"

    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE strlen(text) - strlen(replace(text, ' ', '')) + 1 END AS tokens,
    {hashed("'0:' || coalesce(doc_id::VARCHAR, '')")} AS rank
  FROM documents
), b AS (
  SELECT source, rank // {blocks} AS block, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL
), s AS (
  SELECT source, sum(tokens)::BIGINT AS tokens, sum(tokens) / sum(sum(tokens)) OVER () AS p FROM b GROUP BY source HAVING sum(tokens) > 0
), k AS (SELECT count(*) AS n, max(p) AS top, min(p) AS low, list(p) AS ps FROM s),
e(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (
    SELECT i, lo, hi, mid,
      ln(list_sum(list_transform(ps, lambda p: p ** mid)))
        - mid * list_sum(list_transform(ps, lambda p: p ** mid * ln(p))) / list_sum(list_transform(ps, lambda p: p ** mid))
        >= {mixing.TARGET_ENTROPY} * ln(n) AS ok
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM e, k WHERE i < {steps})
  )
), q(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (
    SELECT i, lo, hi, mid, (low / top) ** (mid - 1) > {mixing.MAX_REPEATS} AS ok
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM q, k WHERE i < {steps})
  )
), a AS (
  SELECT greatest(
    CASE WHEN list_sum(list_transform(ps, lambda p: -p * ln(p))) >= {mixing.TARGET_ENTROPY} * ln(n) THEN 1.0
      ELSE (SELECT lo FROM e WHERE i = {steps}) END,
    CASE WHEN (low / top) ** (-1) <= {mixing.MAX_REPEATS} THEN 0.0
      ELSE (SELECT lo FROM q WHERE i = {steps}) END) AS a, top FROM k
), w AS (
  SELECT source, tokens, floor(tokens * round((p / top) ** (a - 1), 6))::BIGINT AS budget FROM s, a
), plan AS (
  SELECT b.source, block, b.tokens, coalesce(budget // w.tokens, 1) AS epochs, coalesce(budget % w.tokens, 0) AS rest
  FROM b LEFT JOIN w ON b.source IS NOT DISTINCT FROM w.source
), upto AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY {hashed("'0|' || coalesce(source, chr(0)) || '|' || (epochs + 1) || '|' || block")}, block) AS upto
  FROM plan
), rows AS (
  SELECT d.*, u.block, u.epochs, u.rest, u.upto, u.tokens AS block_tokens,
    sum(d.tokens) OVER (PARTITION BY d.source, u.block ORDER BY d.rank, d.doc_id, d.r) AS inside
  FROM d JOIN upto u ON d.source IS NOT DISTINCT FROM u.source AND d.rank // {blocks} = u.block
), copies AS (
  SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1
    WHEN upto - block_tokens < rest AND upto - block_tokens + inside <= rest THEN 1 ELSE 0 END AS n FROM rows
)
SELECT doc_id, source, epoch::INTEGER AS epoch, block::INTEGER AS block,
  {hashed("'0|' || coalesce(source, chr(0)) || '|' || epoch || '|' || block")} AS block_key
FROM (SELECT doc_id, source, block, unnest(range(1, n + 1)) AS epoch FROM copies)
"""


def all_sql() -> dict[str, str]:
    return {
        "op4_sharding": op4_sql(),
        "op8_chat_format": op8_sql(),
        "op9_quality_rules": op9_sql(),
        "op10_mixing": op10_sql(),
    }
