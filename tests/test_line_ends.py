"""Documents rendered as markup hold against their SQL whatever ends their lines and stands in them."""

import duckdb
import pytest

from lorespark.plans import catalog

ODD = ["\r", "\u0085", "\u00a0", "\u2028", "\u2029", "\u2003", "\u3000", "\t", "\u000b", "\u000c", "\u001c", "\u001f", "\u200b"]
WORDS = ["alpha beta", "été là.", "go", "one ---- two", "gamma # delta.", "Zeta = eta", "x\U0001f600y", "kappa - lambda", "mu nu.", "a\\b $1 c"]


def _documents():
    rows = []
    for k, c in enumerate(ODD):
        for n in range(8):
            a, b = WORDS[(k + n) % len(WORDS)], WORDS[(k + 3 * n + 1) % len(WORDS)]
            lines = [a + c, c + b, f"{a} {n}{c}{b}", f"{a}{c}# {b}", f"{b}{c}{c}{a}", "", f"{a}{c}- {b} {a}", f"{b} {n} {a}"]
            rows.append((8 * k + n, "\n".join(lines[n:] + lines[:n])))
    return [*rows, (9001, None), (9002, ""), (9003, "\r\n\r\n"), (9004, "one line.\r\nand another.\r\n")]


@pytest.mark.parametrize("name", ["hx_rst_blocks", "hx_asciidoc_blocks", "hx_rst_markdown", "hx_convert"])
def test_odd_line_ends(spark, tmp_path, name):
    spark.createDataFrame(_documents(), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()[name](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["hx_convert", "hx_rst_blocks"])
def test_every_character(spark, tmp_path, name):
    # Each character of the basic plane (and some above) at the ends and inside of lines, 64 to a document.
    held = [chr(k) for k in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1F600, 0x1F640)]]
    rows = [(k, "\n".join(line for c in held[k : k + 64] for line in (f"ab{c}cd", f"{c}ef", f"gh {c}"))) for k in range(0, len(held), 64)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()[name](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
