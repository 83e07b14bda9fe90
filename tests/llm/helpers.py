"""Small fixtures and plain versions of what the operators compute."""

import re

import duckdb
import pyarrow as pa

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE_TEXT = " ".join(f"word{i}" for i in range(80)) + "."

#: Columns whose names clash with those the operators add.
EXTRA = {"kept": "x", "row": "y", "_text": "z", "slot": "s", "bucket": "b", "component_id": "c", "n_words": "n", "_sha": "h", "maybe_repeated": "m", "ids": "i"}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def edge_docs():
    """Null, empty and blank texts, copies, ties, near copies and a long text."""
    words = BASE_TEXT.split()
    near = " ".join(words[:40] + ["changed"] + words[41:])
    long = "\n".join(" ".join(f"w{(i * 7 + j * 13) % 5000}" for j in range(20)) + "." for i in range(600))
    texts = [None, "", "  \n\t ", "one two three", "one two three", "One TWO three", BASE_TEXT, BASE_TEXT, near, near.upper(), long, long + " end", "a\x00b ß É 漢字\u2028x", None, "| a | b | c | d", "the end"]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def docs_frame(spark, rows, extra=True, source=True):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    names = dict(EXTRA) if extra else {}
    full = [(d, t, None if i % 5 == 4 else "en", f"src{i % 3}" if i % 4 else None, len(t) if t else None, *names.values()) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, schema + "".join(f", `{n}` string" for n in names))


def table(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'")


def documents():
    return table("documents").project("doc_id, text").fetchall()


def rows_of(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def oracle(sql, rows):
    """Rows of a query's DuckDB SQL over documents (doc_id, text), and its column names."""
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    found = con.sql(sql)
    return found.columns, found.fetchall()
