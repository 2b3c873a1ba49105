"""SQL of the order-dependent folds: recursive table expressions that carry a fold's state from row to row."""

from __future__ import annotations

#: Frames one by one, with the last one kept.
KEYFRAMES = """, u AS MATERIALIZED (SELECT video, idx, list_transform(e, lambda x: x / n) AS v FROM (SELECT video, idx, e, greatest(sqrt(list_inner_product(e, e)), 1e-12::DOUBLE) AS n FROM (SELECT video, idx, emb::DOUBLE[] AS e FROM frames))),
  k AS (SELECT video, idx, v, true AS kept FROM u WHERE idx = 0 UNION ALL
    SELECT u.video, u.idx, CASE WHEN list_inner_product(k.v, u.v) < 0.9::DOUBLE THEN u.v ELSE k.v END, list_inner_product(k.v, u.v) < 0.9::DOUBLE FROM k JOIN u ON u.video = k.video AND u.idx = k.idx + 1)
  SELECT video, idx FROM k WHERE kept"""

#: Items one by one, with the sums and centres of all clusters so far.
CLUSTERS = """, u AS MATERIALIZED (SELECT video, idx, emb::DOUBLE[] AS v FROM frames),
  k AS (SELECT video, idx, [v] AS sums, [v] AS centres, 1::BIGINT AS p FROM u WHERE idx = 0 UNION ALL
    SELECT video, idx, CASE WHEN hit THEN list_concat(list_concat(sums[1:p - 1], [m]), sums[p + 1:]) ELSE list_append(sums, v) END,
      CASE WHEN hit THEN list_concat(list_concat(centres[1:p - 1], [list_transform(m, lambda x: x / n)]), centres[p + 1:]) ELSE list_append(centres, v) END, CASE WHEN hit THEN p ELSE len(sums) + 1 END
    FROM (SELECT *, greatest(sqrt(list_inner_product(m, m)), 1e-12::DOUBLE) AS n FROM (SELECT *, list_transform(sums[p], lambda x, j: x + v[j]) AS m FROM (
      SELECT video, idx, v, sums, centres, list_position(near, list_max(near)) AS p, list_max(near) >= 0.45::DOUBLE AS hit FROM (
        SELECT u.video, u.idx, u.v, sums, centres, list_transform(centres, lambda c: list_inner_product(c, u.v)) AS near FROM k JOIN u ON u.video = k.video AND u.idx = k.idx + 1)))))
  SELECT video, idx, p - 1 AS cluster FROM k"""

#: Boxes one by one, with all positions so far; a box moves the first that is near.
LOGOS = """WITH RECURSIVE u AS MATERIALIZED (SELECT user_id AS video, event_id // 4 AS frame, value AS x, value / 2 AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  k AS (SELECT video, i, [{'x': x, 'y': y, 'n': 1::BIGINT, 'f': frame}] AS c FROM u WHERE i = 1 UNION ALL
    SELECT video, i, CASE WHEN p IS NULL OR p = 0 THEN list_append(c, {'x': x, 'y': y, 'n': 1::BIGINT, 'f': frame})
      ELSE list_concat(list_concat(c[1:p - 1], [{'x': c[p].x + (x - c[p].x) / n, 'y': c[p].y + (y - c[p].y) / n, 'n': n, 'f': frame}]), c[p + 1:]) END
    FROM (SELECT *, c[p].n + CASE WHEN c[p].f = frame THEN 0 ELSE 1 END AS n FROM (
      SELECT u.video, u.i, u.frame, u.x, u.y, c, list_position(list_transform(c, lambda a: sqrt((a.x - u.x) * (a.x - u.x) + (a.y - u.y) * (a.y - u.y)) <= 30), true) AS p FROM k JOIN u ON u.video = k.video AND u.i = k.i + 1))),
  l AS (SELECT k.video, unnest(c) AS a, t FROM k JOIN (SELECT video, max(i) AS i, count(DISTINCT frame) AS t FROM u GROUP BY video) z ON z.video = k.video AND z.i = k.i)
  SELECT video, round(a.x, 9) AS x, round(a.y, 9) AS y, a.n AS frames FROM l WHERE a.n >= 0.05::DOUBLE * t"""


def chains(stages: int = 3, kinds: tuple[str, ...] = ("view", "click", "purchase")) -> str:
    """Expressions `chains` (video, session, score, matched, skipped, chain) over `shots`: of each time the states of all stages, and each stage's best so far; `g` is the best state of all."""

    def state(x: str, o: str, text: str, n: str, k: str) -> str:
        return f"{{'x': {x}, 'o': {o}, 'c': {text}, 'n': {n}, 'k': {k}}}"

    empty = state("0.0::DOUBLE", "-1::BIGINT", "''", "0::INT", "0::INT")
    best = ", ".join(f"coalesce(max(b.value) FILTER (b.kind = '{k}'), 0.0::DOUBLE) AS s{i}, arg_max(b.idx, (b.value, -b.idx)) FILTER (b.kind = '{k}') AS o{i}" for i, k in enumerate(kinds))
    held = ", ".join(f"{c}{i}" for c in "bt" for i in range(stages))
    step = f"SELECT u.video, u.session, u.t, {held}, g, {', '.join(f's{i}, o{i}' for i in range(stages))} FROM k JOIN u ON u.video = k.video AND u.session = k.session AND u.t = k.t + 1"
    for i in range(stages):
        here = f"'{i}:' || o{i}"
        rules = [(f"a{i}", f"CASE WHEN s{i} > 0 THEN {state(f's{i}', f'o{i}', here, '1::INT', '0::INT')} ELSE {empty} END"), (f"c{i}", f"CASE WHEN b{i}.x > a{i}.x THEN b{i} ELSE a{i} END")]
        if i:
            on = f"s{i} > 0 AND b{i - 1}.x > 0 AND o{i} - b{i - 1}.o >= 1 AND b{i - 1}.x + s{i} > c{i}.x"
            rules.append((f"d{i}", f"CASE WHEN {on} THEN {state(f'b{i - 1}.x + s{i}', f'o{i}', f"""b{i - 1}.c || '>' || {here}""", f'b{i - 1}.n + 1::INT', f'b{i - 1}.k')} ELSE c{i} END"))
            over = f"m{i - 1}"
            rules.append((f"n{i}", f"CASE WHEN 0.7::DOUBLE * {over}.x > d{i}.x THEN {state(f'0.7::DOUBLE * {over}.x', f'{over}.o', f'{over}.c', f'{over}.n', f'{over}.k + 1::INT')} ELSE d{i} END"))
        else:
            rules.append(("n0", "c0"))
        last = f"g{i - 1}" if i else "g"
        rules += [(f"m{i}", f"CASE WHEN n{i}.x > t{i}.x THEN n{i} ELSE t{i} END"), (f"g{i}", f"CASE WHEN n{i}.x > {last}.x THEN n{i} ELSE {last} END")]
        for name, rule in rules:
            step = f"SELECT *, {rule} AS {name} FROM ({step})"
    return f""", g AS (SELECT video, idx, s, value, kind, sum(CASE WHEN s - p > 24 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY s)::BIGINT AS session FROM (SELECT *, lag(s) OVER (PARTITION BY video ORDER BY s) AS p FROM shots)),
  u AS MATERIALIZED (SELECT a.video, a.session, row_number() OVER (PARTITION BY a.video, a.session ORDER BY a.idx) AS t, {best}
    FROM g a LEFT JOIN g b ON a.video = b.video AND a.session = b.session AND abs(a.idx - b.idx) <= 3 AND b.value > 0 GROUP BY a.video, a.session, a.idx),
  k AS (SELECT DISTINCT video, session, 0::BIGINT AS t, {", ".join(f"{empty} AS {c}{i}" for c in "bt" for i in range(stages))}, {empty} AS g FROM u UNION ALL
    SELECT video, session, t, {", ".join(f"{c}{i}" for c in "nm" for i in range(stages))}, g{stages - 1} FROM ({step})),
  chains AS (SELECT k.video, k.session, round(g.x, 6) AS score, g.n AS matched, g.k AS skipped, g.c AS chain
    FROM k JOIN (SELECT video, session, max(t) AS t FROM u GROUP BY ALL) z ON z.video = k.video AND z.session = k.session AND z.t = k.t WHERE g.c <> '')"""


def segments(boundaries: str, low: float = 3.0, high: float = 30.0) -> str:
    """Expressions `segs` (video, event, first, last) over `boundaries`, a SELECT of video, idx, s, e, score, is_candidate, penalty.

    Stretches between shots over `high` are cut by a dynamic programme whose best sums and ways back are lists; too short ones join the long shot before or, at the start, after.
    """
    low_, high_ = f"{low}::DOUBLE", f"{high}::DOUBLE"
    return f""", w0 AS (SELECT video, idx, s, e, e - s > {high_} AS long, coalesce(score, 0.0::DOUBLE) - 0.55::DOUBLE - CASE WHEN is_candidate THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END - coalesce(penalty, 0.0::DOUBLE) AS reward FROM ({boundaries})),
  w1 AS (SELECT *, sum(long::INT) OVER (PARTITION BY video ORDER BY idx)::BIGINT AS g, max(idx) OVER (PARTITION BY video) AS top FROM w0),
  st AS MATERIALIZED (SELECT video, g, top, min(idx) AS a, max(idx) AS b, count(*) AS m, list(s ORDER BY idx) AS ss, list(e ORDER BY idx) AS es, list(reward ORDER BY idx) AS rs FROM w1 WHERE NOT long GROUP BY video, g, top),
  sk AS MATERIALIZED (SELECT *, es[m] - ss[1] >= {low_} OR (b = top AND g = 0) AS good FROM st),
  dp AS (SELECT video, g, m, 0::BIGINT AS z, [0.0::DOUBLE] AS best, [-1::BIGINT] AS back FROM sk WHERE good UNION ALL
    SELECT video, g, m, z, list_append(best, CASE WHEN list_max(gain) > '-inf'::DOUBLE THEN list_max(gain) + CASE WHEN z < m THEN rs[z] ELSE 0.0::DOUBLE END ELSE '-inf'::DOUBLE END),
      list_append(back, CASE WHEN list_max(gain) > '-inf'::DOUBLE THEN list_position(gain, list_max(gain)) - 1 ELSE -1 END)
    FROM (SELECT *, list_transform(best, lambda x, i: CASE WHEN es[z] - ss[i] >= {low_} AND es[z] - ss[i] <= {high_} THEN x ELSE '-inf'::DOUBLE END) AS gain FROM (
      SELECT dp.video, dp.g, dp.m, z + 1 AS z, best, back, ss, es, rs FROM dp JOIN sk ON sk.video = dp.video AND sk.g = dp.g WHERE z < dp.m))),
  bt AS (SELECT video, g, back, m AS z, CASE WHEN back[m + 1] < 0 THEN 0 ELSE back[m + 1] END AS y FROM dp WHERE z = m UNION ALL SELECT video, g, back, y, back[y + 1] FROM bt WHERE y > 0),
  sg AS (SELECT bt.video, a + y AS first, a + z - 1 AS last FROM bt JOIN sk ON sk.video = bt.video AND sk.g = bt.g UNION ALL
    SELECT l.video, coalesce(p.a, l.idx), coalesce(f.b, l.idx) FROM w1 l LEFT JOIN sk p ON p.video = l.video AND p.g = 0 AND l.g = 1 AND NOT p.good LEFT JOIN sk f ON f.video = l.video AND f.g = l.g AND NOT f.good WHERE long),
  segs AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY first) - 1 AS event, first, last FROM sg)"""


def stage_chains(stages: int, apart: int, skip: float = 0.7) -> str:
    """Expressions `chains` (query_id, video, session, score, matched, skipped, chain, total) over `u`: query_id, video, session, t, n (the query's stages), s0, o0, ...: supports near each time and their places.

    States are as in chains(), for the first n stages; `g` is the best state of any stage so far. total: a chain's hops' scores, summed.
    """

    def state(x: str, o: str, text: str, k: str, v: str) -> str:
        return f"{{'x': {x}, 'o': {o}, 'c': {text}, 'k': {k}, 'v': {v}}}"

    empty = state("0.0::DOUBLE", "-1::BIGINT", "[]::VARCHAR[]", "0::INT", "0.0::DOUBLE")
    held = ", ".join(f"{c}{i}" for c in "bt" for i in range(stages))
    key = "query_id, video, session, t, n"
    step = f"SELECT {', '.join('u.' + c for c in key.split(', '))}, {held}, g, {', '.join(f's{i}, o{i}' for i in range(stages))} FROM k JOIN u ON u.query_id = k.query_id AND u.video = k.video AND u.session = k.session AND u.t = k.t + 1"
    for i in range(stages):
        hop = f"['{i}:' || o{i}]"
        rules = [(f"a{i}", f"CASE WHEN s{i} > 0 THEN {state(f's{i}', f'o{i}', hop, '0::INT', f's{i}')} ELSE {empty} END"), (f"c{i}", f"CASE WHEN b{i}.x > a{i}.x THEN b{i} ELSE a{i} END")]
        if i:
            was = f"b{i - 1}"
            on = f"s{i} > 0 AND {was}.x > 0 AND o{i} - {was}.o >= {apart} AND {was}.x + s{i} > c{i}.x"
            rules.append((f"d{i}", f"CASE WHEN {on} THEN {state(f'{was}.x + s{i}', f'o{i}', f'list_concat({was}.c, {hop})', f'{was}.k', f'{was}.v + s{i}')} ELSE c{i} END"))
            over = f"m{i - 1}"
            rules.append((f"n{i}", f"CASE WHEN {i} < n AND {skip}::DOUBLE * {over}.x > d{i}.x THEN {state(f'{skip}::DOUBLE * {over}.x', f'{over}.o', f'{over}.c', f'{over}.k + 1::INT', f'{over}.v')} ELSE d{i} END"))
        else:
            rules.append(("n0", "c0"))
        rules += [(f"m{i}", f"CASE WHEN n{i}.x > t{i}.x THEN n{i} ELSE t{i} END"), (f"g{i}", f"CASE WHEN n{i}.x > {f'g{i - 1}' if i else 'g'}.x THEN n{i} ELSE {f'g{i - 1}' if i else 'g'} END")]
        for name, rule in rules:
            step = f"SELECT *, {rule} AS {name} FROM ({step})"
    return f"""k AS (SELECT DISTINCT query_id, video, session, 0::BIGINT AS t, n, {", ".join(f"{empty} AS {c}{i}" for c in "bt" for i in range(stages))}, {empty} AS g FROM u UNION ALL
    SELECT {key}, {", ".join(f"{c}{i}" for c in "nm" for i in range(stages))}, g{stages - 1} FROM ({step})),
  chains AS (SELECT k.query_id, k.video, k.session, g.x AS score, len(g.c)::INT AS matched, g.k AS skipped, array_to_string(g.c, '>') AS chain, g.v AS total
    FROM k JOIN (SELECT query_id, video, session, max(t) AS t FROM u GROUP BY ALL) z ON z.query_id = k.query_id AND z.video = k.video AND z.session = k.session AND z.t = k.t WHERE len(g.c) > 0)"""


def stage_supports(stages: int, gap: int, window: int) -> str:
    """Expressions `u` for stage_chains() over `scored` (query_id, stage, video, place, score) and `asks` (query_id, n)."""
    best = ", ".join(f"coalesce(max(b.score) FILTER (b.stage = {i}), 0.0::DOUBLE) AS s{i}, arg_max(b.place, (b.score, -b.place)) FILTER (b.stage = {i}) AS o{i}" for i in range(stages))
    return f"""pl AS (SELECT *, sum(CASE WHEN place - p > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, video ORDER BY place)::BIGINT AS session
    FROM (SELECT query_id, video, place, lag(place) OVER (PARTITION BY query_id, video ORDER BY place) AS p FROM (SELECT DISTINCT query_id, video, place FROM scored))),
  sc AS (SELECT scored.*, session FROM scored JOIN pl USING (query_id, video, place)),
  u AS MATERIALIZED (SELECT a.query_id, a.video, a.session, row_number() OVER (PARTITION BY a.query_id, a.video, a.session ORDER BY a.place) AS t, any_value(n) AS n, {best}
    FROM pl a JOIN asks ON asks.query_id = a.query_id LEFT JOIN sc b ON a.query_id = b.query_id AND a.video = b.video AND a.session = b.session AND abs(a.place - b.place) <= {window} AND b.score > 0 GROUP BY a.query_id, a.video, a.session, a.place)"""
