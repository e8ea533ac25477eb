from collections import Counter

import duckdb
from flowgauge.llm.quality_rules import SQL, quality_rules, query

from tests.llm.conftest import SMALL


def brute(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    return {
        "n_words": len(words), "n_repeat_words": len(covered), "n_dup_lines": len(lines) - len(set(lines)),
        "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
    }


def test_measures_and_edge_cases(spark, documents, prose):
    texts = [
        None, "", " \n\t ", "one", prose(1, 19), prose(2, 20), "é ü " * 10, "a b c d e f g h " * 5, "x " * 100,
        prose(3, 40) + "\n" + prose(3, 40), "l1 w\nl1 w\n\n \nl2 |", prose(4, 30000), "w" * 50000, prose(5, 50) + "#*$%&|<>",
        "a b c d e f g h i a b c d e f g h j b c d e f g h i", "\x0b\x0c\rq",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "no id")]
    found = quality_rules(documents(rows)).collect()
    assert len(found) == len(rows)
    for row in found:
        for name, value in brute(row.text).items():
            assert row[name] == value, (name, row.text and row.text[:50])
        assert row.rep == "own"
        assert row.base_failed == (row.n_words < 20 or row.n_repeat_words * 100 > row.n_words * 30)
        assert not (row.base_failed and row.kept)
    assert quality_rules(documents([])).count() == 0


def test_lines_are_judged(spark, documents, prose):
    good = prose(7, 60)
    menu = "Home | About | News | Contact | Help"
    rows = [
        (1, f"{good}\n{menu}\nThis site uses cookies, accept cookies to go on."),
        (2, "\n".join([menu] * 6 + [prose(8, 25)])),
        (3, " ".join(w + "***" for w in good.split())),
        (4, " ".join(w.upper() + "!!" for w in good.split())),
        (5, good + "\nLicensed under CC BY-NC 4.0."),
    ]
    found = {r.doc_id: r for r in quality_rules(documents(rows)).collect()}
    assert found[1].clean_text == good and found[1].kept and found[1].n_removed_lines == 2
    assert [found[i].kept for i in (2, 3, 4, 5)] == [False, False, False, True]
    assert found[5].n_removed_lines == 0


def test_same_as_sql_and_native(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    relation = connection.sql(SQL)
    df = query(spark, SMALL).select(relation.columns)
    assert sorted(map(tuple, df.collect())) == sorted(relation.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
