"""SQL text for the oracle (DuckDB): the same formulas as ``functions.scoring``,
with every constant written as a DOUBLE (a bare ``0.8`` would be DECIMAL and
change comparisons such as ``abs(a - b) <= 0.1``)."""

from __future__ import annotations

from .. import constants as K


# blanks of str.split(), written out on their own (RE2 has no Unicode \\s)
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def d(v: float) -> str:
    return f"{float(v)!r}::DOUBLE"


def length(s: str) -> str:
    return f"CAST(length(coalesce({s}, '')) AS BIGINT)"


def tokens(s: str) -> str:
    return f"({length(s)}::DOUBLE / {d(K.CHARS_PER_TOKEN)})"


def chat_cost(q: str, r: str) -> str:
    return (f"(({tokens(q)} * {d(K.CHAT_INPUT_USD_PER_TOKEN)} + {tokens(r)} * {d(K.CHAT_OUTPUT_USD_PER_TOKEN)})"
            f" * {d(K.USD_TO_INR)})")


def custom_cost(q: str, r: str) -> str:
    return (f"(({tokens(q)} + {tokens(r)}) / {d(1000)} * {d(K.CUSTOM_USD_PER_1K_TOKENS)} * {d(K.USD_TO_INR)})")


def gemini_cost(q: str, r: str) -> str:
    return (f"(({tokens(q)} / {d(1000)} * {d(K.GEMINI_INPUT_USD_PER_1K)} + {tokens(r)} / {d(1000)} * "
            f"{d(K.GEMINI_OUTPUT_USD_PER_1K)}) * {d(K.USD_TO_INR)})")


def uncertain(r: str, phrases) -> str:
    low = f"lower(coalesce({r}, ''))"
    return "(" + " OR ".join(f"contains({low}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


def word_count(s: str) -> str:
    return f"CAST(len(list_filter(string_split_regex(coalesce({s}, ''), '{BLANKS}'), lambda x: x <> '')) AS BIGINT)"


def grounded_conf(r: str, c: str) -> str:
    cl, rl = length(c), length(r)
    f1 = f"CASE WHEN {cl} > 100 THEN {d(0.8)} WHEN {cl} > 50 THEN {d(0.6)} ELSE {d(0.3)} END"
    f2 = f"CASE WHEN {rl} > 200 THEN {d(0.9)} WHEN {rl} > 100 THEN {d(0.7)} ELSE {d(0.5)} END"
    f3 = f"CASE WHEN {uncertain(r, K.GROUNDED_UNCERTAIN_PHRASES)} THEN {d(0.4)} ELSE {d(0.8)} END"
    return f"(({f1}) + ({f2}) + ({f3})) / {d(3)}"


def bare_conf(q: str, r: str) -> str:
    f1 = f"CASE WHEN {length(r)} > 50 THEN {d(0.8)} ELSE {d(0.5)} END"
    f2 = f"CASE WHEN {word_count(q)} > 5 THEN {d(0.7)} ELSE {d(0.9)} END"
    f3 = f"CASE WHEN {uncertain(r, K.BARE_UNCERTAIN_PHRASES)} THEN {d(0.4)} ELSE {d(0.8)} END"
    return f"(({f1}) + ({f2}) + ({f3})) / {d(3)}"


def dispatched_cost(m: str, q: str, r: str) -> str:
    return (f"CASE WHEN {m} = 'custom' THEN {custom_cost(q, r)} WHEN {m} = 'gemini' THEN {gemini_cost(q, r)} "
            f"ELSE {chat_cost(q, r)} END")


def dispatched_conf(m: str, q: str, r: str, c: str) -> str:
    return (f"CASE WHEN {m} = 'custom' THEN {bare_conf(q, r)} WHEN {m} = 'gemini' THEN {d(K.GEMINI_CONFIDENCE)} "
            f"ELSE {grounded_conf(r, c)} END")


def word_set(s: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(coalesce({s}, '')), '{BLANKS}'), lambda x: x <> ''))"


def overlap(r: str, t: str) -> str:
    rs, ts = word_set(r), word_set(t)
    return (f"CASE WHEN len({ts}) = 0 THEN {d(0.0)} ELSE "
            f"least(len(list_intersect({rs}, {ts}))::DOUBLE / len({ts})::DOUBLE, {d(1.0)}) END")


def safety(*cols: str) -> str:
    g = f"greatest({', '.join(cols)})"
    return f"CASE WHEN {g} IS NULL THEN {d(1.0)} ELSE greatest({d(0.0)}, {d(1.0)} - {g} / {d(K.SAFETY_SEVERITY_SCALE)}) END"


def preview(s: str, n: int = K.PREVIEW_CHARS) -> str:
    return f"CASE WHEN length({s}) > {n} THEN substring({s}, 1, {n}) || '...' ELSE {s} END"
