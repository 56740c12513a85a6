import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import op9_licences as op
from lodestone.llm.licence_texts import ORDINARY, TEMPLATES

from .conftest import prose


def test_classifier():
    c = op.classifier()
    assert c.accuracy > 0.95
    for family, texts in TEMPLATES.items():
        for t in texts:
            shares = c.shares(t)
            assert max(shares, key=shares.get) == family and shares[family] >= op.LEAST_PROBABILITY
            assert re.search(op.ANCHORS, t), t
    for t in ORDINARY:
        assert max(c.shares(t).items(), key=lambda x: x[1])[0] == op.NONE


def test_every_part_of_a_template_has_an_anchor():
    for texts in TEMPLATES.values():
        for t in texts:
            words = t.lower().split()
            for i in range(max(1, len(words) - 7)):
                assert re.search(op.ANCHORS, " ".join(words[i : i + 8])), words[i : i + 8]


def test_grants_without_the_word_licence(spark):
    texts = [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        " ".join(t for t in TEMPLATES["mit"] if "without restriction" in t).split("without restriction")[0] + "without restriction",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.doc_id, r.families) for r in op.scan(docs).orderBy("doc_id").collect()] == [(0, "isc"), (1, "mit")]


LINES = [
    ("Licensed under the Apache License, Version 2.0.", "apache", True),
    ("Released under the MIT License.", "mit", True),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl", True),
    ("Licensed under CC BY-NC 4.0.", "cc", True),
    ("Copyright (c) 2020 Someone. All rights reserved.", "proprietary", None),
    ("You need a license to drive this car on the public road", None, None),
    ("no anchor here", None, None),
]


def test_paragraphs_against_the_model_itself(spark):
    texts = [(i, prose(i, 30) + "\n" + line + "\n" + prose(i + 50, 20)) for i, (line, *_) in enumerate(LINES)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.paragraph): r for r in op.scan_paragraphs(docs, ["doc_id"]).collect()}
    c = op.classifier()
    for i, text in texts:
        for k, p in enumerate(text.split("\n")):
            if not re.search(op.ANCHORS, p.lower()):
                assert (i, k) not in got
                continue
            shares = c.shares(p)
            best = max(shares, key=shares.get)
            if best == op.NONE:
                assert (i, k) not in got
            else:
                r = got[i, k]
                assert r.family == (best if shares[best] >= op.LEAST_PROBABILITY else op.UNKNOWN)
                assert r.probability == pytest.approx(shares[best])
    found = {i: r for (i, _), r in got.items()}
    for i, (_, family, confirmed) in enumerate(LINES):
        assert (found[i].family if i in found else None) == family
        assert confirmed is None or found[i].confirmed == confirmed


def test_frames(spark, odd, odd_rows, none):
    text = "MIT\nReleased under the MIT License.\nLicensed under CC BY 4.0"
    extra = [0] * (len(odd.columns) - 5)
    more = [(20, text), (20, text), (None, text), (21, "license")]
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "s", 0, *extra) for i, t in more], odd.schema))
    got = op.scan(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows + more)
    assert sorted((r.n_known, r.n_confirmed, r.families) for r in got if r.doc_id == 20) == [(2, 2, "cc,mit")] * 2
    assert [r.families for r in got if r.doc_id is None and r.n_known] == ["cc,mit"]
    assert all(r.families == "" and r.best_family is None for r in got if r.doc_id in (1, 2, 3, 4))
    assert op.scan(none).count() == 0


def test_plan_has_no_python(odd):
    plan = op.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and np.isfinite(op.classifier().weights).all()
