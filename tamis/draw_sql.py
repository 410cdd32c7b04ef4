"""SQL of the sequential parts of a draw: guarantees, the choice of units, and promotion.

Each is a recursive table with one row for each step.  The operators of the library reach the same rows by stacks and
queues; here every step looks at the whole pool, as the rules are written.
"""

from __future__ import annotations

from tamis.operators.draw import REASONS

#: Shares of the standard rules: categories in hundredths of a percent, guarantees in percent.
_SHARES = "(VALUES (0, 'OPEN', 5050), (1, 'CAT_A', 1500), (2, 'CAT_B', 750), (3, 'CAT_C', 2700)) AS v(ord, code, pct)"
_MINIMA = (("WOMEN", 30), ("PWD", 5), ("EX_SERVICE", 3), ("SENIOR", 5))
_WAITLIST = 150


def _codes(col: str) -> str:
    return f"list_filter(string_split({col}, ','), lambda x : x <> '')"


def _with_guarantees(name: str, ranking: str, plan: str) -> str:
    """{name}_won (pool, application_id, rk, st: 1 by rank, 2 promoted, 3 displaced) and the steps {name} that led there."""
    least = ", ".join(f"{{'code': '{c}', 'need': CAST((seats * {pct} * 2 + 100) // 200 AS INTEGER)}}" for c, pct in _MINIMA)
    has = "len(list_filter(people, lambda x : x.st IN (1, 2) AND list_contains(x.codes, z.code)))"
    return f"""
{name}(pool, n, step, minima, people, guarantee, had, act, promoted, displaced) AS (
  SELECT pool, 1, 0, [{least}], list({{'rk': rk, 'id': application_id, 'codes': codes, 'st': CASE WHEN rk <= seats THEN 1 ELSE 0 END}} ORDER BY rk), 0, 0, 'start', '', ''
  FROM {ranking} JOIN {plan} USING (pool) GROUP BY pool, seats
  UNION ALL
  SELECT pool, CASE act WHEN 'go' THEN n ELSE n + 1 END, step + 1, minima,
    CASE act WHEN 'go' THEN list_transform(people, lambda x : {{'rk': x.rk, 'id': x.id, 'codes': x.codes, 'st': CASE WHEN x.rk = caller.rk THEN 2 WHEN x.rk = victim.rk THEN 3 ELSE x.st END}}) ELSE people END,
    n, had[n], act, caller.id, victim.id
  FROM (SELECT *, CASE WHEN minima[n].need <= had[n] THEN 'full' WHEN caller IS NULL THEN 'short' WHEN victim IS NULL THEN 'stuck' ELSE 'go' END AS act
    FROM (SELECT *, list_filter(people, lambda x : x.st IN (1, 2) AND NOT list_has_any(x.codes, guarded))[-1] AS victim
      FROM (SELECT *, list_transform(list_filter(minima, lambda z, i : i = n OR (i <= n AND z.need > 0 AND had[i] <= z.need)), lambda z : z.code) AS guarded,
          list_filter(people, lambda x : x.st NOT IN (1, 2) AND list_contains(x.codes, minima[n].code))[1] AS caller
        FROM (SELECT pool, n, step, minima, people, list_transform(minima, lambda z : {has}) AS had FROM {name} WHERE n <= len(minima)))))),
{name}_won AS (SELECT pool, x.id AS application_id, x.rk AS rk, x.st AS st FROM (SELECT pool, unnest(arg_max(people, step)) AS x FROM {name} GROUP BY pool) WHERE x.st > 0),
{name}_notes AS (SELECT pool, CAST(guarantee - 1 AS INTEGER) AS h_ord, minima[guarantee].code AS code, CAST(minima[guarantee].need AS INTEGER) AS required, CAST(arg_min(had, step) AS INTEGER) AS had,
  coalesce(string_agg(promoted, ',' ORDER BY step) FILTER (act = 'go'), '') AS promoted, coalesce(string_agg(displaced, ',' ORDER BY step) FILTER (act = 'go'), '') AS displaced,
  count(*) FILTER (act = 'go') AS made, minima[guarantee].need - arg_min(had, step) AS missing, arg_max(act, step) AS ended FROM {name} WHERE step > 0 GROUP BY pool, guarantee, minima HAVING missing > 0)"""


def draw_ctes(people: str = "v_application", seed: str = "''") -> str:
    """The draw by the standard rules over people (application_id, vertical_code, horizontal_codes, residency_years): d_sel, d_notes, d_ranking."""
    reserved = "SELECT pool FROM d_plan WHERE ord > 0"
    won = lambda *of: " UNION ALL ".join(f"SELECT application_id FROM {x}_won WHERE st < 3" for x in of)
    order = "ORDER BY tier, ticket, application_id"
    return f"""
d_units AS (SELECT greatest(1, count(*) // 4) AS total FROM v_flat_unit WHERE NOT withdrawn),
d_shares AS (SELECT ord, code, pct * total // 10000 AS fl, pct * total % 10000 AS rem, total FROM {_SHARES}, d_units),
d_plan AS (SELECT ord, code AS pool, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, ord) <= total - sum(fl) OVER () THEN 1 ELSE 0 END AS INTEGER) AS seats FROM d_shares),
d_people AS (SELECT application_id, vertical_code, {_codes('horizontal_codes')} AS codes, sha256('ticket/1|' || {seed} || '|' || application_id) AS ticket, CASE WHEN residency_years >= 3 THEN 0 ELSE 1 END AS tier FROM {people}),
d_open AS (SELECT 'OPEN' AS pool, *, row_number() OVER ({order}) AS rk FROM d_people), {_with_guarantees('d1', 'd_open', 'd_plan')},
d_rest AS (SELECT vertical_code AS pool, *, row_number() OVER (PARTITION BY vertical_code {order}) AS rk FROM d_people WHERE vertical_code IN ({reserved}) AND application_id NOT IN ({won('d1')})), {_with_guarantees('d2', 'd_rest', 'd_plan')},
d_lapsed AS (SELECT 'OPEN_LAPSED' AS pool, CAST((SELECT sum(seats) FROM d_plan WHERE ord > 0) - (SELECT count(*) FROM d2_won WHERE st < 3) AS INTEGER) AS seats),
d_last AS (SELECT 'OPEN_LAPSED' AS pool, *, row_number() OVER ({order}) AS rk FROM d_people WHERE (SELECT seats FROM d_lapsed) > 0 AND application_id NOT IN ({won('d1', 'd2')})), {_with_guarantees('d3', 'd_last', 'd_lapsed')},
d_ranking AS (SELECT * FROM d_open UNION ALL SELECT * FROM d_rest UNION ALL SELECT * FROM d_last),
d_notes AS (SELECT pool, h_ord, code, required, had, promoted, displaced, code || ': ' || CASE WHEN ended = 'stuck' THEN made || ' of ' || missing || ' missing seats filled; all other winners hold a guaranteed seat'
  WHEN made < missing THEN made || ' of ' || missing || ' missing seats filled; the pool has no further holder of the code' ELSE 'all ' || made || ' missing seats filled by promotion' END AS note
  FROM (SELECT * FROM d1_notes UNION ALL SELECT * FROM d2_notes UNION ALL SELECT * FROM d3_notes)),
d_states AS (SELECT * FROM d1_won UNION ALL SELECT * FROM d2_won UNION ALL SELECT * FROM d3_won),
d_pools AS (SELECT ord AS pool_ord, pool, seats FROM d_plan UNION ALL SELECT 4, pool, seats FROM d_lapsed WHERE seats > 0),
d_sizes AS (SELECT pool_ord, pool, seats, (SELECT count(*) FROM d_ranking k WHERE k.pool = p.pool) AS candidates FROM d_pools p),
d_winners AS (SELECT * FROM d_states WHERE st < 3),
d_waiting AS (SELECT application_id, pool, rk, row_number() OVER (PARTITION BY pool ORDER BY rk) AS position, pool_ord FROM d_ranking JOIN d_sizes USING (pool) WHERE application_id NOT IN (SELECT application_id FROM d_winners)),
d_best AS (SELECT * FROM d_waiting QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY position, pool_ord) = 1),
d_rows AS (SELECT r.application_id, ticket AS ticket_hex, tier AS residency_tier, w.pool AS won, w.st, coalesce(w.pool, b.pool, 'OPEN') AS pool_code, CAST(coalesce(w.rk, b.rk, 0) AS INTEGER) AS rank_in_pool,
  CASE WHEN w.pool IS NULL AND position <= {_WAITLIST} THEN CAST(position AS INTEGER) END AS waitlist_position, r.application_id IN (SELECT application_id FROM d_states WHERE st = 3) AS pushed
  FROM d_people r LEFT JOIN d_winners w USING (application_id) LEFT JOIN d_best b USING (application_id)),
d_reasons AS (SELECT d.* EXCLUDE (won, st, pushed), CASE WHEN won IS NOT NULL THEN 'SELECTED' WHEN waitlist_position IS NOT NULL THEN 'WAITLISTED' ELSE 'NOT_SELECTED' END AS outcome,
  CASE WHEN won = 'OPEN_LAPSED' THEN 'SELECTED_IN_LAPSED_OPEN_POOL' WHEN st = 1 THEN 'SELECTED_ON_MERIT' WHEN st = 2 THEN 'SELECTED_VIA_HORIZONTAL_MINIMUM' WHEN pushed THEN 'DISPLACED_BY_HORIZONTAL_MINIMUM'
    WHEN coalesce(seats, 0) = 0 THEN 'NOT_SELECTED_NO_SEATS_IN_POOL' WHEN waitlist_position IS NOT NULL THEN 'WAITLISTED_BEHIND_SELECTED' ELSE 'NOT_SELECTED_RANK_BELOW_SEATS' END AS reason_code,
  coalesce(seats, 0) AS seats, coalesce(candidates, 0) AS candidates FROM d_rows d LEFT JOIN d_sizes z ON z.pool = pool_code),
d_sel AS (SELECT * EXCLUDE (seats, candidates), CASE outcome WHEN 'SELECTED' THEN 'Selected in pool ' || pool_code || ' at rank ' || rank_in_pool || ' of ' || candidates || ' candidates for ' || seats || ' seats.'
  ELSE 'Ranked ' || rank_in_pool || ' of ' || candidates || ' in pool ' || pool_code || ', which had ' || seats || ' seats.' || coalesce(' Waitlist position ' || waitlist_position || '.', '') END
  || CASE reason_code {' '.join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in REASONS.items())} END AS reason_text FROM d_reasons)"""


def assigned_ctes(selections: str, preferences: str) -> str:
    """a_given: the unit of each winner of selections, who choose in the order of their tickets; preferences has application_id, wants."""
    stock = "list_transform(generate_series(1, len(kinds)), lambda i : ids[i][used[i] + 1])"
    return f"""
a_picks AS (SELECT application_id, coalesce(wants, []) AS wants, row_number() OVER (ORDER BY ticket_hex, application_id) AS pick FROM {selections} LEFT JOIN {preferences} USING (application_id) WHERE outcome = 'SELECTED'),
a_kinds AS (SELECT unit_type, list(unit_id ORDER BY unit_id) AS ids, list(block ORDER BY unit_id) AS blocks FROM v_flat_unit WHERE NOT withdrawn GROUP BY 1),
a_stock AS (SELECT coalesce(list(unit_type ORDER BY unit_type), []) AS kinds, coalesce(list(ids ORDER BY unit_type), []) AS ids, coalesce(list(blocks ORDER BY unit_type), []) AS blocks FROM a_kinds),
a_steps(pick, used, application_id, kind, place, wish, n_wants) AS (
  SELECT CAST(0 AS BIGINT), list_transform(kinds, lambda z : CAST(0 AS BIGINT)), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM a_stock
  UNION ALL
  SELECT pick, list_transform(used, lambda z, i : CASE WHEN i = kind THEN z + 1 ELSE z END), application_id, kind, used[kind] + 1, wish, len(wants)
  FROM (SELECT *, coalesce(CASE WHEN wish > 0 THEN list_position(kinds, wants[wish]) ELSE list_position(heads, list_min(heads)) END, 0) AS kind
    FROM (SELECT *, CAST(coalesce(list_position(list_transform(wants, lambda t : coalesce(heads[list_position(kinds, t)] IS NOT NULL, false)), true), 0) AS BIGINT) AS wish
      FROM (SELECT w.pick, w.application_id, w.wants, used, kinds, ids, {stock} AS heads FROM a_steps JOIN a_picks w ON w.pick = a_steps.pick + 1, a_stock)))),
a_given AS (SELECT 'DRAW-1' AS draw_id, application_id, ids[kind][place] AS unit_id, kinds[nullif(kind, 0)] AS unit_type, blocks[kind][place] AS block, CAST(pick AS INTEGER) AS pick_order, CAST(wish AS INTEGER) AS preference_rank,
  CASE WHEN kind = 0 THEN 'inventory exhausted' WHEN wish > 0 THEN 'preference ' || wish || ' of ' || n_wants || ' honoured' WHEN n_wants > 0 THEN 'all stated preferences exhausted; lowest-numbered available unit assigned'
    ELSE 'no preference stated; lowest-numbered available unit assigned' END AS basis FROM a_steps, a_stock WHERE pick > 0)"""


def promoted_ctes(selections: str, ranking: str, forfeited: str, holders: str, declined: str) -> str:
    """p_made: whom each seat of forfeited goes to, in the order of tickets; all three are queries of application_id."""
    return f"""
p_gone AS (SELECT application_id, pool_code, row_number() OVER (ORDER BY ticket_hex, application_id) AS k, application_id IN ({holders}) AS held FROM {selections} WHERE application_id IN ({forfeited})),
p_free AS (SELECT pool, list({{'id': r.application_id, 'rk': rk, 'open': k IS NULL AND r.application_id NOT IN ({declined}), 'since': CASE WHEN held THEN k ELSE 0 END}} ORDER BY rk) AS free
  FROM {ranking} r LEFT JOIN p_gone g ON g.application_id = r.application_id WHERE k IS NOT NULL OR r.application_id NOT IN ({holders}) GROUP BY pool),
p_steps(k, called, vacated_by, promoted, pool, promotion_position, rk) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), '', '', '', 0, CAST(0 AS BIGINT)
  UNION ALL
  SELECT k, CASE WHEN who IS NULL THEN called ELSE list_append(called, who.id) END, application_id, who.id, pool_code,
    CASE WHEN who IS NULL THEN 0 ELSE CAST(1 + len(list_filter(free, lambda x : x.rk < who.rk AND x.since <= k AND NOT list_contains(called, x.id))) AS INTEGER) END, who.rk
  FROM (SELECT g.k, called, g.application_id, g.pool_code, free, list_filter(free, lambda x : x.open AND NOT list_contains(called, x.id))[1] AS who
    FROM p_steps JOIN p_gone g ON g.k = p_steps.k + 1 LEFT JOIN p_free f ON f.pool = g.pool_code)),
p_made AS (SELECT vacated_by, promoted, pool, promotion_position, CASE WHEN promoted IS NULL THEN 'the waitlist of pool ' || pool || ' is used up; the seat stays open for a later draw'
  ELSE 'called from the waitlist of pool ' || pool || ' at rank ' || rk || ' in place of ' || vacated_by END AS basis FROM p_steps WHERE k > 0)"""
