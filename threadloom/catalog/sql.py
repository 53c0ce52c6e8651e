"""Building blocks of the oracle SQL, written for DuckDB from the raw tables."""

from __future__ import annotations

from ..functions import rules


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]"  # what counts as white space, spelled for this dialect
NAME = r"[\p{L}\p{N}_]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def mention(x: str) -> str:
    return f"lower(nullif(regexp_extract({x}, '^@({NAME})', 1), ''))"


def clean(x: str) -> str:
    t = f"regexp_replace({strip(x)}, '^@{NAME}{SPACE}*', '')"
    t = f"regexp_replace({t}, 'https?://[^{SPACE[1:]}+', '[URL]', 'g')"
    t = strip(f"regexp_replace({t}, '{SPACE}+', ' ', 'g')")
    return f"coalesce({t}, '')"


def clean_keep_space(x: str) -> str:
    t = rf"regexp_replace({x}, '^@[A-Za-z0-9_]+\s*', '')"
    return rf"coalesce(regexp_replace({t}, 'https?://\S+', '[URL]', 'g'), '')"


def n_words(x: str) -> str:
    pieces = f"len(regexp_split_to_array({strip(x)}, '{SPACE}+'))"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {strip(x)} = '' THEN 0 ELSE {pieces} END"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def count(x: str = "*") -> str:
    return f"CAST(count({x}) AS BIGINT)"


def total(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT)"


def pct2(part: str, whole: str) -> str:
    return f"round(CAST({part} AS DOUBLE) / greatest({whole}, 1) * 100, 2)"


DM = "(?i)" + "|".join(rules.DM_REDIRECT)
HUMAN = "|".join(rules.HUMAN_REQUEST)
STOP = ", ".join(q(w) for w in rules.ENGLISH_STOP_WORDS)

TWEETS = r"""
last_turns AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id),
raw AS (
  SELECT c.conv_id, c.turn, c.role, c.text AS body, c.conv_id * 100 + c.turn + 1 AS tid,
         'Brand' || CAST(c.conv_id % 4 AS VARCHAR) AS brand, 'u' || CAST(c.conv_id % 50 AS VARCHAR) AS cust, l.last_turn
  FROM conversations c JOIN last_turns l ON c.conv_id = l.conv_id
),
tweets AS (
  SELECT tid AS tweet_id,
    CASE role WHEN 'assistant' THEN brand WHEN 'user' THEN cust ELSE 'SystemBot' END AS author_id,
    role = 'user' AS inbound,
    CASE WHEN tid % 37 = 0 THEN 'bad date'
         ELSE strftime(TIMESTAMP '2017-10-01 00:00:00' + to_minutes(tid), '%a %b %d %H:%M:%S +0000 %Y') END AS created_at,
    CASE role
      WHEN 'user' THEN '@' || brand || ' ' || CASE WHEN conv_id % 9 = 0 THEN 'please help me now' ELSE body END
        || CASE WHEN conv_id % 6 = 0 THEN ' https://t.co/x' || CAST(turn AS VARCHAR) ELSE '' END
        || CASE WHEN conv_id % 11 = 0 THEN ' i want to talk to a human' ELSE '' END
        || CASE WHEN conv_id % 13 = 0 THEN ' this is fraud' ELSE '' END
      WHEN 'assistant' THEN '@' || cust || ' ' || body || CASE WHEN conv_id % 8 = 0 THEN ' Please DM us your details' ELSE '' END
      ELSE body END AS text,
    CASE WHEN conv_id % 5 = 0 OR turn = last_turn THEN NULL
         WHEN conv_id % 5 = 1 THEN CAST(tid + 1 AS VARCHAR) || ',' || CAST(tid + 3 AS VARCHAR)
         ELSE CAST(tid + 1 AS VARCHAR) END AS response_tweet_id,
    CASE WHEN turn > 0 THEN tid - 1 END AS in_response_to_tweet_id
  FROM raw
)
"""

SLICED = f"""
sliced AS (
  SELECT *, lower(author_id) AS author_lower, CASE WHEN inbound THEN {mention('text')} ELSE lower(author_id) END AS brand
  FROM tweets WHERE CASE WHEN inbound THEN {mention('text')} ELSE lower(author_id) END IS NOT NULL
),
reply_ids AS (
  SELECT tweet_id, list_filter(list_transform(string_split(response_tweet_id, ','),
    lambda x: TRY_CAST(TRY_CAST(x AS DOUBLE) AS BIGINT)), lambda y: y IS NOT NULL) AS ids
  FROM tweets
)
"""


def pairs(pick: str = "last") -> str:
    at = "-1" if pick == "last" else "1"
    return f"""
named AS (SELECT s.*, nullif(r.ids[{at}], 0) AS named_reply FROM sliced s JOIN reply_ids r USING (tweet_id) WHERE s.inbound),
m1 AS (
  SELECT n.*, b.tweet_id AS response_id, b.text AS r_text, b.author_id AS support_author
  FROM named n JOIN sliced b ON b.tweet_id = n.named_reply AND b.brand = n.brand AND b.author_lower = n.brand
),
children AS (
  SELECT *, row_number() OVER (PARTITION BY in_response_to_tweet_id, brand ORDER BY tweet_id) AS rn
  FROM sliced WHERE author_lower = brand AND in_response_to_tweet_id IS NOT NULL
),
m2 AS (
  SELECT n.*, c.tweet_id AS response_id, c.text AS r_text, c.author_id AS support_author
  FROM named n JOIN children c ON c.in_response_to_tweet_id = n.tweet_id AND c.brand = n.brand AND c.rn = 1
  WHERE n.tweet_id NOT IN (SELECT tweet_id FROM m1)
),
pairs AS (SELECT *, true AS by_reply_id FROM m1 UNION ALL SELECT *, false AS by_reply_id FROM m2)
"""


def _line(a: str) -> str:
    return f"'[' || CASE WHEN {a}.inbound THEN 'customer' ELSE 'support' END || ']: ' || " + clean(f"{a}.text")


CONVERSATIONS = f"""
ctx AS (
  SELECT p.*, concat_ws(' | ', CASE WHEN a3.tweet_id IS NOT NULL THEN {_line('a3')} END,
                               CASE WHEN a2.tweet_id IS NOT NULL THEN {_line('a2')} END,
                               CASE WHEN a1.tweet_id IS NOT NULL THEN {_line('a1')} END) AS conversation_context
  FROM pairs p
  LEFT JOIN sliced a1 ON a1.tweet_id = p.in_response_to_tweet_id AND a1.brand = p.brand
  LEFT JOIN sliced a2 ON a2.tweet_id = a1.in_response_to_tweet_id AND a2.brand = p.brand
  LEFT JOIN sliced a3 ON a3.tweet_id = a2.in_response_to_tweet_id AND a3.brand = p.brand
),
convs AS (
  SELECT substr(md5(CAST(tweet_id AS VARCHAR) || '_' || CAST(response_id AS VARCHAR)), 1, 12) AS conversation_id, brand,
    {clean('text')} AS customer_message, {clean('r_text')} AS historical_support_response, created_at AS "timestamp",
    conversation_context, author_id AS customer_author, support_author,
    CAST(in_response_to_tweet_id AS VARCHAR) AS parent_tweet_id, CAST(response_id AS VARCHAR) AS response_tweet_id,
    CAST(CASE WHEN conversation_context = '' THEN 2 ELSE len(string_split(conversation_context, ' | ')) + 2 END AS BIGINT) AS conversation_length,
    tweet_id AS customer_tweet_id
  FROM ctx
),
usable AS (
  SELECT *, regexp_matches(historical_support_response, {q(DM)}) AS is_dm_redirect
  FROM convs WHERE length({strip('customer_message')}) > 5 AND length({strip('historical_support_response')}) > 5
),
deduped AS (
  SELECT *, row_number() OVER (PARTITION BY brand, customer_message ORDER BY customer_tweet_id, response_tweet_id) AS rn FROM usable
),
prepared AS (SELECT * EXCLUDE (rn) FROM deduped WHERE rn = 1 AND {n_words('customer_message')} >= 3)
"""

ALL_CONVERSATIONS = (TWEETS, SLICED, pairs(), CONVERSATIONS)

REQUESTS = """
requests AS (
  SELECT tweet_id, text, (tweet_id % 100) / 100.0::DOUBLE AS intent_confidence,
         CASE WHEN tweet_id % 17 <> 0 THEN (tweet_id % 10) / 10.0::DOUBLE END AS best_score,
         tweet_id % 19 = 0 AS generator_escalates
  FROM tweets WHERE inbound
)
"""


def sensitive(x: str) -> str:
    parts = ", ".join(f"CASE WHEN contains({x}, {q(w)}) THEN {q(w)} END" for w in rules.SENSITIVE)
    return f"concat_ws(', ', {parts})"


def decided(source: str, conf: float = 0.4, quality: float = 0.3, generator: str = "generator_escalates") -> str:
    """CTEs `signals` and `decided` over a relation with text, intent_confidence, best_score."""
    return f"""
signals AS (
  SELECT *, regexp_matches({strip('lower(text)')}, {q(HUMAN)}) AS asked, {sensitive('lower(text)')} AS found,
         coalesce(intent_confidence, 0) < {conf}::DOUBLE AS unsure, best_score IS NULL AS no_case,
         best_score IS NULL OR best_score < {quality}::DOUBLE AS weak, coalesce({generator}, false) AS advised
  FROM {source}
),
decided AS (
  SELECT *, CASE WHEN asked THEN 'explicit_human_request' WHEN found <> '' THEN 'sensitive_content'
                 WHEN unsure THEN 'low_intent_confidence' WHEN weak THEN 'insufficient_evidence'
                 WHEN advised THEN 'llm_recommendation' ELSE 'policy_and_confidence_gate' END AS decision_source
  FROM signals
)
"""


DECISION_SCORE = """CASE decision_source WHEN 'explicit_human_request' THEN 1.0 WHEN 'sensitive_content' THEN 0.9
  WHEN 'low_intent_confidence' THEN 0.85 WHEN 'insufficient_evidence' THEN 0.8 WHEN 'llm_recommendation' THEN 0.75 ELSE 0.1 END::DOUBLE"""


def tfidf(prefix: str, source: str, id_col: str, text: str, min_df: int, max_df: float, max_features: int, sublinear: bool,
          apply_to: tuple[str, str, str] | None = None) -> str:
    """CTEs {prefix}_counts, _vocab, _weights (id, term, w normalised), fitted on `source`.

    With `apply_to` (relation, id, text) also {prefix}_other for a second relation.
    """
    def counts(name, rel, i, t):
        return f"""
{name}_words AS (
  SELECT {i} AS id, list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({STOP})) AS w FROM {rel}
),
{name}_counts AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_words
  ) GROUP BY id, term
)"""

    def weights(name):
        tf = "(1 + ln(c.tf))" if sublinear else "c.tf"
        return f"""
{name}_raw AS (SELECT c.id, c.term, {tf} * v.idf AS w FROM {name}_counts c JOIN {prefix}_vocab v USING (term)),
{name}_norm AS (SELECT id, sqrt(sum(w * w)) AS len FROM {name}_raw GROUP BY id),
{name}_weights AS (SELECT r.id, r.term, r.w / n.len AS w FROM {name}_raw r JOIN {name}_norm n USING (id))"""

    parts = [counts(prefix, source, id_col, text), f"""
{prefix}_n AS (SELECT count(*) AS n FROM {source}),
{prefix}_vocab AS (
  SELECT term, df, cf, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {prefix}_counts GROUP BY term
  ), {prefix}_n WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * n ORDER BY cf DESC, term LIMIT {max_features}
)""", weights(prefix)]
    if apply_to:
        parts += [counts(f"{prefix}o", *apply_to), weights(f"{prefix}o")]
    return ",".join(parts)


VECTORS = """
vectors AS (
  SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS v, e.label, coalesce(d.text, '') AS text,
    CASE e.label % 4 WHEN 0 THEN 'playback_issues' WHEN 1 THEN 'account_access' WHEN 2 THEN 'billing_payment' ELSE 'general_inquiry' END AS intent,
    CASE WHEN e.vec_id % 7 = 0 THEN 'I checked your account: ' ELSE '' END || coalesce(d.source, '') AS reply
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
),
sims AS (
  SELECT a.id AS q_id, b.id AS d_id, round(list_inner_product(a.v, b.v), 9) AS score FROM vectors a, vectors b WHERE a.id <> b.id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) AS "rank" FROM sims)
"""


def reranked(k: int = 5, pool: int = 15, floor: float = 0.35) -> str:
    align = " OR ".join(
        f"(a.intent = {q(i)} AND ({any_of('lower(b.text)', w)} OR {any_of('lower(b.reply)', w)}))"
        for i, w in rules.INTENT_ALIGNMENT.items()
    )
    return f"""
wordsets AS (SELECT id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS ws FROM vectors),
boosted AS (
  SELECT r.q_id, r.d_id, r."rank" AS base_rank, r.score AS base_score,
    r.score + (0.05::DOUBLE * CASE WHEN len(x.ws) > 0 THEN len(list_intersect(x.ws, y.ws))::DOUBLE / len(x.ws) ELSE 0 END
               + CASE WHEN {align} THEN 0.05::DOUBLE ELSE 0::DOUBLE END) AS score
  FROM ranked r JOIN vectors a ON a.id = r.q_id JOIN vectors b ON b.id = r.d_id
    JOIN wordsets x ON x.id = r.q_id JOIN wordsets y ON y.id = r.d_id
  WHERE r."rank" <= {pool} AND r.score >= {floor}::DOUBLE
),
hits AS (
  SELECT q_id, d_id, base_score, score, "rank" FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, base_rank) AS "rank" FROM boosted
  ) WHERE "rank" <= {k}
)
"""


SCORES = """
scores AS (
  SELECT doc_id AS item_id, d AS dimno, 'd' || CAST(d AS VARCHAR) AS dim, (1 + (doc_id * 7 + d * 3) % 5)::DOUBLE AS human,
    least(greatest(1 + (doc_id * 7 + d * 3) % 5 + (doc_id + d) % 3 - 1, 1), 5)::DOUBLE AS judge
  FROM labels, range(0, 7) AS t(d)
)
"""
