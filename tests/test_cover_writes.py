"""Coverage writes its candidates' items once, whatever the number of rounds."""

from tidemark.operators import packing
from tidemark.work import Work


def test_items_are_written_once(spark, monkeypatch):
    rows = spark.createDataFrame([(g, i, i, [f"{j}" for j in range(i, i + 40)]) for g in range(2) for i in range(50)], "g int, position int, id int, items array<string>")
    written, write = [], Work.write

    def counted(self, df, name):
        out = write(self, df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(Work, "write", counted)
    got = packing.cover(rows, "g", 3).orderBy("g", "pick").collect()
    assert [(r["g"], r["id"], r["gained"]) for r in got] == [(g, *x) for g in range(2) for x in ((0, 40), (40, 40), (49, 9))]
    # 4,000 items, gains of 100 candidates each round, and the items of picks; the open items of each round were 10,000 and more
    assert sum(written) <= 4000 + 3 * 100 + 2 * 2 * 40 + 6
