"""Registered queries against DuckDB, and against brute force where SQL can't say them."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import oracle  # noqa: E402

from sparkquill.llm import media, pii  # noqa: E402
from sparkquill.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.fixture(scope="module")
def whole(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, con, name):
    oracle.compare(spark, con, sf, QUERIES[name], ORACLE_SQL[name])


def test_token_ids(spark, sf, whole):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for r, (i, text) in zip(sorted(QUERIES["op2_token_coder"](spark, sf).collect()), sorted(whole.items()), strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_media(spark, sf, whole):
    rows = QUERIES["op3_media_columns"](spark, sf).collect()
    assert len(rows) == len(whole)
    for r in rows:
        data = (whole[r.doc_id] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.from_png(media.to_png(payload)) == payload and r.media_sha256 == hashlib.sha256(media.to_png(payload)).hexdigest()


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, sf, whole):
    for r in QUERIES["op8_pii"](spark, sf).collect():
        spans = plain_pii(whole[r.doc_id] or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= {*r.spans.split(","), ""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in spans) for j in range(4))


def test_toxicity(spark, sf, con):
    rows = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    con = oracle.connect(sf)
    labels = dict(con.execute("SELECT doc_id, toxic FROM labels").fetchall())
    rows = [r for r in QUERIES["op7_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    clean = [r for r in rows if not labels[r.doc_id]]
    toxic = [r for r in rows if labels[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.93 * len(rows)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)  # many labels of other languages look like noise
