"""How many of the pairs that share a run of 200 characters equal lines would find: ``python tests/llm/line_recall.py FOLDER``.

Only pairs of different texts count. A unit is a line as it stands, of at least so many characters.
"""

import sys

import duckdb

SHARED = """CREATE TABLE d AS SELECT doc_id, text FROM '{folder}/documents.parquet' WHERE length(text) >= 200;
CREATE TABLE w AS SELECT DISTINCT doc_id, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d);
CREATE TABLE m AS SELECT doc_id, h FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h);
CREATE TABLE p AS SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id JOIN d x ON x.doc_id = a.doc_id JOIN d y ON y.doc_id = b.doc_id WHERE x.text <> y.text"""
LINES = """CREATE OR REPLACE TABLE l AS SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE length(line) >= {least};
CREATE OR REPLACE TABLE q AS SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM l a JOIN l b ON a.line = b.line AND a.doc_id < b.doc_id"""

if __name__ == "__main__":
    con = duckdb.connect()
    con.execute(SHARED.format(folder=sys.argv[1]))
    total = con.sql("SELECT count(*) FROM p").fetchall()[0][0]
    for least in (200, 100, 40):
        con.execute(LINES.format(least=least))
        found, candidates = con.sql("SELECT (SELECT count(*) FROM p SEMI JOIN q USING (a, b)), (SELECT count(*) FROM q)").fetchall()[0]
        print(f"lines of {least} or more: {found} of {total} pairs ({found / max(1, total):.0%}) among {candidates} candidates")
