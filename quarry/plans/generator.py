"""The draws of Python's seeded generator (Mersenne Twister 19937) in DuckDB SQL, for the twins of seeded queries."""

from __future__ import annotations

#: Fixed values of the generator: its first word, the factors of its seeding, its matrix, the masks of its output.
FIRST, SPREAD, BY_KEY, BY_PLACE = 19650218, 1812433253, 1664525, 1566083941
MATRIX, MASK_7, MASK_15 = 0x9908B0DF, 0x9D2C5680, 0xEFC60000
WORD, HIGH, LOW = 0xFFFFFFFF, 0x80000000, 0x7FFFFFFF


def _folded(v: str) -> str:
    return f"xor({v}, {v} >> 30)"


def _turned(high: str, low: str, far: str) -> str:
    """The word after the next 623: the high bit of one word and the rest of its follower, through the matrix, upon a later word."""
    return f"xor({far}, xor((({high} & {HIGH}) | ({low} & {LOW})) >> 1, ({low} & 1) * {MATRIX}))"


def _turned_list(a: str, b: str, far: str) -> str:
    return f"list_transform(list_zip({a}, {b}, {far}), lambda z: {_turned('z[1]', 'z[2]', 'z[3]')})"


def draws_cte(sizes: str, n: int, seed: int = 0) -> str:
    """gd (size, b, place), one row a draw of ``n`` resamples; ``sizes`` is a query of the sizes. For WITH RECURSIVE.

    gx is the state before the key, gy and gz those of the two passes of seeding;
    gt has 624 words a turn, in runs that need no word of their own."""
    first = _turned_list("s[1:227]", "s[2:228]", "s[398:624]")
    second = _turned_list("s[228:454]", "s[229:455]", "one")
    third = _turned_list("s[455:623]", "s[456:624]", "two[1:169]")
    keyed = lambda old, last: f"(xor({old}, ({_folded(last)} * {BY_KEY}) & {WORD}) + {seed}) & {WORD}"
    placed = lambda old, last, i: f"(xor({old}, ({_folded(last)} * {BY_PLACE}) & {WORD}) - {i}) & {WORD}"
    return f"""
gs AS (SELECT DISTINCT CAST(size AS BIGINT) AS size, length(bin(size)) AS bits FROM ({sizes})),
gx AS (SELECT 0 AS i, {FIRST}::BIGINT AS v UNION ALL SELECT i + 1, ({SPREAD} * {_folded("v")} + i + 1) & {WORD} FROM gx WHERE i < 623),
gy AS (SELECT 0 AS i, {FIRST}::BIGINT AS v UNION ALL SELECT gy.i + 1, {keyed("gx.v", "gy.v")} FROM gy JOIN gx ON gx.i = gy.i + 1),
g1 AS (SELECT {keyed("a.v", "b.v")} AS v FROM gy a, gy b WHERE a.i = 1 AND b.i = 623),
gz AS (SELECT 1 AS i, v FROM g1 UNION ALL SELECT gz.i + 1, {placed("gy.v", "gz.v", "gy.i")} FROM gz JOIN gy ON gy.i = gz.i + 1),
g0 AS (SELECT [{HIGH}, (SELECT {placed("g1.v", "gz.v", "1")} FROM g1, gz WHERE gz.i = 623)] || (SELECT list(v ORDER BY i) FROM gz WHERE i > 1) AS s),
gt AS (SELECT 0 AS turn, s FROM g0 UNION ALL SELECT turn + 1, one || two || three || [{_turned("s[624]", "one[1]", "two[170]")}]
  FROM (SELECT *, {third} AS three FROM (SELECT *, {second} AS two FROM (SELECT *, {first} AS one FROM gt WHERE turn < (SELECT max({n} * (1 << bits)) * 21 // 20 // 624 + 20 FROM gs))))),
gw AS (SELECT turn, unnest(s) AS a, generate_subscripts(s, 1) AS i FROM gt WHERE turn > 0),
ga AS (SELECT turn, i, xor(a, a >> 11) AS a FROM gw),
gb AS (SELECT turn, i, xor(a, (a << 7) & {MASK_7}) AS a FROM ga),
gc AS (SELECT turn, i, xor(a, (a << 15) & {MASK_15}) AS a FROM gb),
gd AS (SELECT size, b, place FROM (SELECT size, place, (row_number() OVER (PARTITION BY size ORDER BY turn, i) - 1) // size AS b
  FROM (SELECT size, turn, i, xor(a, a >> 18) >> (32 - bits) AS place FROM gc, gs) WHERE place < size) WHERE b < {n})"""
