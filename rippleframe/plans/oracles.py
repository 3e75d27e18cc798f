"""SQL builders for the registered queries' twins."""

from __future__ import annotations

from rippleframe.operators.filters import BANKS, CHROMA_DOWN, CHROMA_UP, PHASES, bank_taps, synthesis_taps

#: Fixed values, stated again so that a wrong one in the operators shows: lifting steps and gains, gains of prediction and update, weights of the temporal levels.
STEPS = (-1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971)
HIGH_GAIN, LOW_GAIN = 0.869864451624781, 1.149604398860241
ALPHA, BETA = "sqrt(23 / 32.0)", "sqrt(1.5)"
WEIGHTS = {
    "H": (1.0, 0.92470128353329, 0.99029103222357, 1.12001265233249, 1.28641274725767, 1.48343269251745, 1.71234593056217, 1.97708086092642),
    "L": (1.0, 1.10554159678513, 1.26197963240006, 1.45296631451356, 1.67651411818611, 1.93551742673391, 2.23484071726601, 2.58054224785086),
}


def copied(kind: str, level: int) -> str:
    """The gain of a copied frame, as SQL: the low weight a level up over its own, over the gain of its step."""
    above = WEIGHTS["L"][level - 1] if level else WEIGHTS[kind][0]
    return f"({above!r} / {WEIGHTS[kind][level]!r} / {ALPHA if kind == 'H' else BETA})"


__all__ = ["BANKS", "CHROMA_DOWN", "CHROMA_UP", "PHASES", "bank_taps", "synthesis_taps"]


def rq(e: str, digits: int = 6) -> str:
    return f"(CASE WHEN abs({e}) < 5e-{digits + 1} THEN 0.0 ELSE round({e}, {digits}) END)"


def lift(src: str, keys: str, idx: str, val: str) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY n)"
    q = f"SELECT {keys}, CAST({idx} // 2 AS INT) AS n, l, h FROM (SELECT {keys}, {idx}, {val} AS l, lead({val}) OVER (PARTITION BY {keys} ORDER BY {idx}) AS h FROM {src}) WHERE {idx} % 2 = 0"
    for k, step in enumerate(STEPS):
        if k % 2 == 0:
            q = f"SELECT {keys}, n, l, h + {step!r} * (l + coalesce(lead(l) {w}, lag(l) {w})) AS h FROM ({q})"
        else:
            q = f"SELECT {keys}, n, l + {step!r} * (h + coalesce(lag(h) {w}, lead(h) {w})) AS l, h FROM ({q})"
    return f"SELECT {keys}, n, l * {LOW_GAIN!r} AS l, h * {HIGH_GAIN!r} AS h FROM ({q})"


def wavelet(src: str, name: str, keys: str = "frame") -> str:
    """CTEs that end in `name` (keys, band, y, x, c) of src (keys, y, x, v)."""
    return f"""{name}_d AS ({lift(src, f"{keys}, x", "y", "v")}),
{name}_t AS (SELECT {keys}, 0 AS half, n AS y, x, l AS v FROM {name}_d UNION ALL SELECT {keys}, 1, n, x, h FROM {name}_d),
{name}_a AS ({lift(f"{name}_t", f"{keys}, half, y", "x", "v")}),
{name} AS (SELECT {keys}, CASE half WHEN 0 THEN 'LL' ELSE 'LH' END AS band, y, n AS x, l AS c FROM {name}_a
 UNION ALL SELECT {keys}, CASE half WHEN 0 THEN 'HL' ELSE 'HH' END, y, n, h FROM {name}_a)"""


def taps(pairs: dict[int, float]) -> str:
    return "(VALUES " + ", ".join(f"({o}, {float(w)!r})" for o, w in pairs.items()) + ") t(_o, w)"


def reflected(k: str, n: str) -> str:
    m = f"((({k}) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2))"
    return f"least({m}, 2 * {n} - 2 - {m})"


def fir(src: str, axis: str, n: int, pairs: dict[int, float], half: int | None, keys: str = "frame", edge: str = "reflect") -> str:
    """SELECT of the filtered src along axis; half keeps one parity and halves the axis."""
    other = "x" if axis == "y" else "y"
    k = f"a.{axis} + _o"
    where = reflected(k, str(n)) if edge == "reflect" else f"greatest(0, least({n - 1}, {k}))"
    kept = f"WHERE a.{axis} % 2 = {half}" if half is not None else ""
    out = f"CAST(a.{axis} // 2 AS INT)" if half is not None else f"a.{axis}"
    own = ", ".join(f"a.{c}" for c in keys.split(", "))
    same = " AND ".join(f"s.{c} = a.{c}" for c in keys.split(", "))
    pair = f"{out} AS {axis}, a.{other} AS {other}"
    return f"SELECT {own}, {pair}, sum(s.v * w) AS v FROM {src} a CROSS JOIN {taps(pairs)} JOIN {src} s ON {same} AND s.{other} = a.{other} AND s.{axis} = {where} {kept} GROUP BY ALL"


def up(src: str, axis: str, n: int, pairs: dict[int, float], start: int, keys: str = "frame") -> str:
    """SELECT of src up-sampled along axis from n samples to 2n."""
    other = "x" if axis == "y" else "y"
    own = ", ".join(f"s.{c}" for c in keys.split(", "))
    k = reflected("g.i + _o", str(2 * n))
    return f"SELECT {own}, CAST(g.i AS INT) AS {axis}, s.{other} AS {other}, sum(s.v * w) AS v FROM (SELECT unnest(range({2 * n})) AS i) g CROSS JOIN {taps(pairs)} JOIN {src} s ON 2 * s.{axis} + {start} = {k} GROUP BY ALL"


def bank(src: str, name: str, n: int, number: int) -> str:
    """CTEs that end in `name` (frame, band, y, x, c): src through a filter bank."""
    parts = (("LL", f"{name}_0", 0), ("HL", f"{name}_0", 1), ("LH", f"{name}_1", 0), ("HH", f"{name}_1", 1))
    tall = ", ".join(f"{name}_{h} AS MATERIALIZED ({fir(src, 'y', n, bank_taps(number, h), h)})" for h in (0, 1))
    return f"{tall}, {name} AS MATERIALIZED ({' UNION ALL '.join(f"""SELECT frame, '{b}' AS band, y, x, v AS c FROM ({fir(s, 'x', n, bank_taps(number, k), k)})""" for b, s, k in parts)})"


def low(name: str) -> str:
    return f"{name}_low AS MATERIALIZED (SELECT frame, y, x, c AS v FROM {name} WHERE band = 'LL')"
