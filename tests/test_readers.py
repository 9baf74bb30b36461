"""Readers over many files: scans per header, files told apart by their paths, empty files."""

from fairline.sources import readers

HEADS = ("Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,PSH,PSD,PSA", "HomeTeam,Date,AwayTeam,FTHG,FTAG,FTR,AvgCH,AvgCD,AvgCA", "﻿Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,PSH,PSD,PSA")


def test_many_files_take_one_scan_per_header(spark, tmp_path):
    files, want = {}, set()
    for i in range(60):
        folder = tmp_path / f"league {i % 3} ü%"
        folder.mkdir(exist_ok=True)
        p, head = folder / f"{2000 + i // 3}.csv", HEADS[i % 3]
        rows = []
        for j in range(3):
            cell = {"Date": f"{j + 1:02d}/09/{2000 + i // 3}", "HomeTeam": f"H{i}", "AwayTeam": f"A{j}", "FTHG": "1", "FTAG": "0", "FTR": "H"}
            rows.append(",".join(cell.get(c.lstrip("﻿"), "2.5") for c in head.split(",")))
            want.add((f"E{i % 3}", 2000 + i // 3, f"H{i}", f"A{j}"))
        p.write_text("\n".join([head, *rows]) + "\n", encoding="utf-8")
        files[(f"E{i % 3}", 2000 + i // 3)] = str(p)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    files |= {("X", 2000): str(tmp_path / "empty.csv"), ("X", 2001): str(tmp_path / "other.csv")}
    got = readers.read_results(spark, files)
    rows = got.collect()
    assert len(rows) == 180 and {(r["league"], r["season"], r["home_team"], r["away_team"]) for r in rows} == want
    assert all((r["odds_AvgC_H"] == 2.5) == (r["league"] == "E1") and (r["odds_PS_H"] == 2.5) == (r["league"] != "E1") for r in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # a byte order mark makes no other header


def test_no_file_and_empty_files(spark, tmp_path):
    assert readers.read_results(spark, {}).count() == 0
    p = tmp_path / "e.csv"
    p.write_text("")
    assert readers.read_results(spark, {("E0", 2000): str(p)}).count() == 0
