"""Snippets of checking SQL used by several queries."""

from slipstack import fixed

SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
AMOUNT, PREFIX = fixed.AMOUNT_PATTERN, fixed.AMOUNT_PREFIX
FOUND = rf"{PREFIX}({AMOUNT})(?:\D|$)"
SIGNED = rf"(?:(?:^|[^-])-\s?|\(\s?){PREFIX}{AMOUNT}(?:\D|$)"


def clean(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), '{SPACE}+', ' ', 'g'))"


def found(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{FOUND}', 1)"


def signed(expr: str) -> str:
    return f"regexp_matches({expr}, '{SIGNED}')"


def distinct_cents(cleaned: str) -> str:
    digits = "replace(replace(v, ',', ''), '.', '')"
    return (
        f"list_distinct([CAST({digits} AS BIGINT) for v in {found(cleaned)} if length({digits}) <= 14])"
    )


def fast_total(cleaned: str) -> str:
    return (
        f"CASE WHEN len({distinct_cents(cleaned)}) = 1 AND NOT {signed(cleaned)} "
        f"THEN {distinct_cents(cleaned)}[1] END"
    )


def parse_amount(expr: str) -> str:
    bare = f"regexp_replace({expr}, '{SPACE}|[$€£]', '', 'g')"
    pattern = r"^(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d{1,2}))?$"
    whole, dec = f"regexp_extract({bare}, '{pattern}', 1)", f"regexp_extract({bare}, '{pattern}', 2)"
    digits = f"replace({whole}, ',', '')"
    return (
        f"CASE WHEN {whole} <> '' AND NOT (contains({whole}, ',') AND {dec} = '') AND length({digits}) <= 12 "
        f"THEN CAST({digits} AS BIGINT) * 100 + CAST(rpad({dec}, 2, '0') AS BIGINT) END"
    )


def grouped(cents: str) -> str:
    return f"format('{{:,}}', {cents} // 100) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')"


def js_round(expr: str) -> str:
    return f"CAST(floor({expr} + 0.5) AS BIGINT)"


CAPACITY = (
    "CASE layout "
    + " ".join(f"WHEN '{name}' THEN {len(slots)}" for name, (_, _, slots) in fixed.LAYOUTS.items())
    + f" ELSE {len(fixed.LAYOUTS[fixed.DEFAULT_LAYOUT][2])} END"
)
SLOTS = (
    "slots(layout, slot, grid_row, grid_col, col_span, row_span, n_rows, n_cols) AS (VALUES "
    + ", ".join(
        str((name, i, *slot, rows, cols)) for name, (rows, cols, slots) in fixed.LAYOUTS.items() for i, slot in enumerate(slots)
    )
    + ")"
)
KNOWN = f"CASE WHEN layout IN ({', '.join(map(repr, fixed.LAYOUTS))}) THEN layout ELSE '{fixed.DEFAULT_LAYOUT}' END"
