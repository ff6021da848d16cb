"""Pieces of SQL that the queries' oracles share (DuckDB)."""

from __future__ import annotations


def name(x: str, keep: bool = False) -> str:
    """A station's name, normalised."""
    s = f"lower(regexp_replace(coalesce({x}, ''), '\\([^)]*\\)', ' ', 'g'))"
    for a, b in (("ü", "ue"), ("ö", "oe"), ("ä", "ae"), ("ß", "ss")):
        s = f"replace({s}, '{a}', '{b}')"
    s = f"strip_accents({s})"
    if keep:
        s = f"regexp_replace(regexp_replace({s}, '\\bhbf\\.?\\b', 'hauptbahnhof', 'g'), '\\bbf\\.?\\b', 'bahnhof', 'g')"
    else:
        s = f"regexp_replace(regexp_replace({s}, '\\b(hauptbahnhof|bahnhof)\\b', ' ', 'g'), '\\b(hbf|bf)\\.?\\b', ' ', 'g')"
    return f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"


def tokens_match(station: str, candidate: str) -> str:
    """Of two lists of tokens; see the column expression of that name."""
    same = lambda x, y: f"(starts_with({x}, {y}) OR starts_with({y}, {x}))"
    out, n = [], f"len({station})"
    for skip in range(3):
        tail = f"{candidate}[{skip + 1}:]"
        every = f"len(list_filter(range(1, {n} + 1), lambda i: {same(f'{tail}[i]', f'{station}[i]')})) = {n}"
        moved = f"{tail}[CASE WHEN i > k THEN i + 1 ELSE i END]"
        parts = f"length({tail}[k]) >= 3 AND length({tail}[k + 1]) >= 3 AND length({tail}[k]) + length({tail}[k + 1]) <= length({station}[k]) AND starts_with({station}[k], {tail}[k]) AND ends_with({station}[k], {tail}[k + 1])"
        rest = f"len(list_filter(range(1, {n} + 1), lambda i: i = k OR {same(moved, f'{station}[i]')})) = {n}"
        out += [f"len({tail}) = {n} AND {every}", f"len({tail}) = {n} + 1 AND len(list_filter(range(1, {n} + 1), lambda k: {parts} AND {rest})) > 0"]
    return "(" + " OR ".join(f"({x})" for x in out) + ")"


def names_match(a: str, a_whole: str, b: str, b_whole: str) -> str:
    """The full rule for names in both normalised forms: equal, one part of the other, or alike by tokens either way."""
    x, y = (f"(CASE WHEN {a} <> '' AND {b} <> '' THEN {own} ELSE {whole} END)" for own, whole in ((a, a_whole), (b, b_whole)))
    tx, ty = (f"string_split({v}, ' ')" for v in (x, y))
    return f"({x} <> '' AND {y} <> '' AND ({x} = {y} OR length({x}) >= 3 AND contains({y}, {x}) OR length({y}) >= 3 AND contains({x}, {y}) OR {tokens_match(tx, ty)} OR {tokens_match(ty, tx)}))"


def ref(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace(coalesce({x}, ''), '\\s*\\([^()]*\\)\\s*$', ''), '\\s+', '', 'g'))"


def metres(lon_a: str, lat_a: str, lon_b: str, lat_b: str) -> str:
    return f"sqrt(power(({lon_b} - {lon_a}) * 111320.0e0 * cos(radians({lat_a})), 2) + power(({lat_b} - {lat_a}) * 111320.0e0, 2))"


def half_up(x: str, digits: int = 0) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def row_ref(line: str, kind: str) -> str:
    r, k = ref(line), ref(kind)
    return f"CASE WHEN {r} = '' THEN '' WHEN NOT regexp_matches({r}, '^\\d+[a-z]?$') THEN {r} WHEN {k} IN ('re', 'rb', 's', 'rs', 'mex', 'r') THEN {k} || {r} ELSE '' END"


DELAY = """CASE WHEN planned IS NULL THEN NULL WHEN changed IS NULL THEN 0.0e0
    WHEN abs(epoch_us(changed) - epoch_us(planned)) / 6e7 > 1440 THEN NULL ELSE greatest(0.0e0, (epoch_us(changed) - epoch_us(planned)) / 6e7) END"""

BUCKET = "CASE WHEN delay < 21 THEN CAST(floor(delay) AS INTEGER) WHEN delay < 31 THEN 21 WHEN delay < 46 THEN 22 WHEN delay < 61 THEN 23 WHEN delay < 91 THEN 24 ELSE 25 END"

EDGES = "[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 31, 46, 61, 91]"


def quantile(hist: str, p: float, key: str, source: str) -> str:
    """A query of (key, q): the quantile of each row's histogram."""
    return f"""SELECT {key}, min(CASE WHEN total = 0 THEN 0.0e0 WHEN high <= low THEN low ELSE {half_up(f"low + ({p} * total - before) / x * (high - low)")} END) AS q
        FROM (SELECT {key}, i, x, total, CAST({EDGES}[i] AS DOUBLE) AS low, CAST(CASE WHEN i = 26 THEN 91 ELSE {EDGES}[i + 1] - 1 END AS DOUBLE) AS high,
                sum(x) OVER (PARTITION BY {key} ORDER BY i) - x AS before, sum(x) OVER (PARTITION BY {key} ORDER BY i) AS upto
            FROM (SELECT {key}, unnest({hist}) AS x, unnest(range(1, 27)) AS i, list_sum({hist}) AS total FROM {source}))
        WHERE upto >= {p} * total AND (x > 0 OR total = 0) AND before < {p} * total OR total = 0 GROUP BY {key}"""
