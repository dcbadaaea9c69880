"""The command line runs the end-to-end jobs on CSV inputs."""

import glob
import os
import tempfile

import pandas as pd

from tessera.__main__ import main


def _csv(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_cli_performance_index_and_profile(spark):
    d = tempfile.mkdtemp(prefix="tessera-cli-")
    _csv(f"{d}/foam.csv", "Sample,Foam (cc),Texture,Foam (cc),Texture,Foam (cc),Texture\n"
                          "A,10,p,,x,4,r\nB,,p,5,q,6,q\n")
    _csv(f"{d}/w.csv", "Normalized_Texture,Weight\np,5\nq,3\nr,1\ns,2\n")
    main(["performance-index", f"{d}/foam.csv", f"{d}/w.csv", f"{d}/out", "--days", "2", "--key", "Sample"])
    out = pd.concat(pd.read_csv(f) for f in glob.glob(f"{d}/out/*.csv"))
    row = out.set_index(out.columns[0]).loc["A"]
    assert row["valid"] == True  # noqa: E712
    assert abs(row["score_texture"] - (5 + 3 + 1)) < 1e-9  # x between p and r → nearest weight to 3 is q
    assert pd.isna(out.set_index(out.columns[0]).loc["B"]["performance_index"])
    main(["profile", f"{d}/foam.csv", f"{d}/prof"])
    assert glob.glob(f"{d}/prof/profile/*.csv")


def test_cli_lablog(spark):
    d = tempfile.mkdtemp(prefix="tessera-cli-log-")
    os.makedirs(f"{d}/logs")
    _csv(f"{d}/logs/a.csv", '"0.5% APG, 20 ppm SDS (S1)",stable 4C,,,\n20X,45C 5cc,10 mL tube,,\n'
                            "Day,Date,Foam (cc),Foam Texture,\nDay 0,2024-01-01,40 cc,fine,*\n"
                            "Day 1,2024-01-02,30 cc,coarse,\n")
    main(["lablog", f"{d}/logs", f"{d}/out", "--cols", "5"])
    single = pd.concat(pd.read_csv(f) for f in glob.glob(f"{d}/out/single/*.csv"))
    assert single.iloc[0]["Day 0 - Foam (cc)"] == 40.0 and single.iloc[0]["Dilution Ratio"] == "20X"


def test_cli_half_life_and_stability(spark):
    d = tempfile.mkdtemp(prefix="tessera-cli-hl-")
    _csv(f"{d}/decay.csv", "Sample,Time (0.0),Time (60m),Time (2h)\nA,100,75*,50\nB,80,,\n")
    main(["half-life", f"{d}/decay.csv", f"{d}/hl", "--method", "linear", "--key", "Sample"])
    out = pd.concat(pd.read_csv(f) for f in glob.glob(f"{d}/hl/*.csv")).set_index("Sample")
    assert abs(out.loc["A", "half_life"] - 2.0) < 1e-9 and pd.isna(out.loc["B", "half_life"])
    _csv(f"{d}/obs.csv", "Sample,Observation day 7,Observation day 14\nA,no gel,Gel formed\nB,clear,\n")
    main(["stability", f"{d}/obs.csv", f"{d}/st", "--key", "Sample"])
    st = pd.concat(pd.read_csv(f) for f in glob.glob(f"{d}/st/*.csv")).set_index("Sample")
    assert st.loc["A", "shelf_life_days"] == 14 and st.loc["A", "stable_14d"] == False  # noqa: E712
    assert pd.isna(st.loc["B", "stable_14d"])
