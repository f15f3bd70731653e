"""Pre-tokens of byte-level BPE, cut inside DuckDB, one connection per task.

RE2 knows no lookahead. The pattern's `\\s+(?!\\S)|\\s+` differs from `\\s+` only where two or more
white-space characters stand before another character; texts with such a place are cut by the
`regex` library instead, all others by regexp_extract_all. Both spell white space out, since the
libraries differ in what \\s covers.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa

#: White_Space of Unicode, as the inside of a character class.
_SPACE_RE2 = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), _SPACE_RE2)
RUN_BEFORE_TEXT = rf"[{_SPACE_RE2}]{{2}}[^{_SPACE_RE2}]"


def re2_pattern(pattern: str) -> str:
    """The public pattern for RE2: no lookahead, white space spelled out."""
    cut = pattern.replace(r"\s+(?!\S)|", "")
    return cut.replace(r"[^\s", f"[^{_SPACE_RE2}").replace(r"\s+", f"[{_SPACE_RE2}]+")


@lru_cache(maxsize=4)
def slow_pattern(pattern: str):
    import regex

    spelled = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s+", f"[{_SPACE}]+").replace(r"\S", f"[^{_SPACE}]")
    return regex.compile(spelled)


def connect(memory: str = "320MB"):
    """An in-process database that may spill to this task's own temporary folder."""
    import tempfile

    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": tempfile.mkdtemp(prefix="duck-"), "preserve_insertion_order": False})


def disconnect(con) -> None:
    """Close a database of connect() and remove its folder."""
    import shutil

    (folder,) = con.execute("SELECT current_setting('temp_directory')").fetchone()
    con.close()
    shutil.rmtree(folder, ignore_errors=True)


def cut(con, rows: list[int], texts: list[str], pattern: str) -> None:
    """Leaves table piece_rows(doc int, pieces varchar[]) for the texts in con."""
    given = pa.table({"doc": pa.array(rows, pa.int32()), "text": pa.array(texts, pa.string())})
    con.register("given", given)
    con.execute("CREATE OR REPLACE TEMP TABLE piece_rows AS SELECT doc, regexp_extract_all(text, $fast) AS pieces FROM given WHERE NOT regexp_matches(text, $odd)", {"fast": re2_pattern(pattern), "odd": RUN_BEFORE_TEXT})
    odd = con.execute("SELECT doc, text FROM given WHERE regexp_matches(text, $odd)", {"odd": RUN_BEFORE_TEXT}).fetchall()
    if odd:
        find = slow_pattern(pattern).findall
        con.register("odd_rows", pa.table({"doc": pa.array([d for d, _ in odd], pa.int32()), "pieces": pa.array([find(t) for _, t in odd], pa.list_(pa.string()))}))
        con.execute("INSERT INTO piece_rows SELECT doc, pieces FROM odd_rows")
        con.unregister("odd_rows")
    con.unregister("given")
