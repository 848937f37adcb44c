"""Scans that are killed and repeated, and rescans of what has changed, against whole scans."""

import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siftstone.operators import match, staged
from siftstone.operators.match import Rule

FILES = "path string, platform string, content string, file_seq long"
RULES = [Rule(1, "c", "stone", r"stone\b", gate="WHEN PRESENT e"), Rule(2, "c", "sand", "sand", exclude="quick"), Rule(3, "c", "number", "[0-9]+"), Rule(4, "c", "named", "gravel", gate="WHEN FILE_NAME_IS f1.txt")]


def rows_of(df):
    return Counter(tuple(r[c] for c in ("path", "rule_seq", "line", "code", "pass_no")) for r in df.collect())


def some(rng, n):
    words = ["stone", "STONE", "sand", "quicksand", "7", "gravel", "e", ""]
    return "\n".join(" ".join(rng.choices(words, k=3)) for _ in range(n))


def test_a_killed_scan_goes_on(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"d/f{i}.txt", f"p{i % 4}", some(rng, 5), i) for i in range(60)]
    files = spark.createDataFrame(rows, FILES)
    platforms, asked = [f"p{i}" for i in range(4)], []
    whole = rows_of(match.evidence(files, RULES))

    def kill_at_third(platform):
        asked.append(platform)
        if len(asked) == 3:
            raise KeyboardInterrupt

    first = staged.Stages.resume(spark, str(tmp_path), "settings")
    with pytest.raises(KeyboardInterrupt):
        staged.scan(first, files, RULES, platforms, kill_at_third)
    first.fail(interrupted=True)
    # what an attempt wrote before it was killed isn't seen without its commit
    staged._cast(match.evidence(files, RULES)).write.parquet(f"{tmp_path}/data/pattern_matching/run={first.run}/attempt=dead")
    half = staged.Stages.resume(spark, str(tmp_path), "settings")
    assert half.run == first.run and half.left("pattern_matching", platforms) == ["p2", "p3"]
    assert rows_of(staged.scan(half, files, RULES, platforms, asked.append)) == whole and asked == ["p0", "p1", "p2", "p2", "p3"]
    # again: nothing is scanned, and nothing counts twice; nor if a part is committed by two attempts
    assert rows_of(staged.scan(half, files, RULES, platforms, asked.append)) == whole and len(asked) == 5
    half.commit("pattern_matching", "p0", "dead")
    assert rows_of(half.read("pattern_matching", staged.EVIDENCE)) == whole
    half.complete()
    other = staged.Stages.resume(spark, str(tmp_path), "settings")
    assert other.run != first.run and other.read("pattern_matching", staged.EVIDENCE).count() == 0
    assert staged.Stages.resume(spark, str(tmp_path), "other settings").run not in (first.run, other.run)


def test_rescans_equal_whole_scans(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    files = {f"d/f{i}.txt": some(rng, 4) for i in range(40)}
    rules = list(RULES)
    real, scanned = match.evidence, []

    def counted(df, *args, **options):
        scanned.append(df.count())
        return real(df, *args, **options)

    monkeypatch.setattr(staged.match, "evidence", counted)
    for turn in range(4):
        df = spark.createDataFrame([(p, "x", t, i) for i, (p, t) in enumerate(sorted(files.items()))], FILES)
        assert rows_of(staged.rescan(spark, df, rules, str(tmp_path))) == rows_of(real(df, rules)), turn
        if turn == 0:  # edits, deletions, new files, one of them a copy
            for k, p in enumerate(rng.sample(sorted(files), 8)):
                if k < 5:
                    files[p] = some(rng, 4)
                else:
                    del files[p]
            files["d/new.txt"] = files["d/copy.txt"] = some(rng, 3)
        elif turn == 1:  # rules change, go, come, and are numbered anew
            rules = [replace(rules[0], seq=7, regex="STONE"), replace(rules[2], seq=1), Rule(2, "c", "last", "e$")]
    assert scanned[0] == 40 and scanned[1] == 7 and scanned[2] == len(files) and scanned[3] == 0


def test_a_killed_rescan_leaves_the_last_state(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "x", "stone e\nsand", 1), ("b", "x", "", 2), ("c", "x", None, 3)], FILES)
    first = rows_of(staged.rescan(spark, df, RULES, str(tmp_path)))
    more = df.unionByName(spark.createDataFrame([("d", "x", "sand 5", 4)], FILES))
    write = staged.Stages.write

    def dies(self, stage, part, rows):
        if stage == "seen":
            raise RuntimeError("lost")
        write(self, stage, part, rows)

    monkeypatch.setattr(staged.Stages, "write", dies)
    with pytest.raises(RuntimeError):
        staged.rescan(spark, more, RULES, str(tmp_path))
    monkeypatch.undo()
    assert rows_of(staged.rescan(spark, df, RULES, str(tmp_path))) == first == rows_of(match.evidence(df, RULES))
    assert rows_of(staged.rescan(spark, more, RULES, str(tmp_path))) == rows_of(match.evidence(more, RULES))
    assert staged.rescan(spark, df.limit(0), RULES, str(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="the same"):
        staged.rescan(spark, df.filter(F.lit(True)), [RULES[0], replace(RULES[0], seq=9)], str(tmp_path))
