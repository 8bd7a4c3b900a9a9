import random
import time

import pytest

from pliego.llm import html

SCHEMA = "page_id bigint, url string, html string"


@pytest.mark.parametrize("name", ["comment-list", "user-comments", "ad-slot", "site-footer", "left-sidebar", "alert", "ad_box", "social-share-links"])
@pytest.mark.parametrize("how", ["class", "id", "role"])
def test_frame_names_with_further_words(name, how):
    frame = f"<div {how}='{name}'><p>gone</p></div>"
    assert html.blocks(f"<body><article><p>The text of it</p>{frame}</article></body>") == [("The text of it", True)]
    assert html.blocks(f"<body><article><p>The text of it</p></article>{frame}</body>") == [("The text of it", True)]
    assert html.blocks(f"<body><p>The text of it</p>{frame}</body>") == [("The text of it", False)]


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "with-banner", "nav-fixed", "advertising-history", "footer-height", "content-area", "list"])
def test_names_that_are_no_frame(name):
    assert html.blocks(f"<body><article><p>Text</p><div class='{name}'>more</div></article></body>") == [("Text", True), ("more", True)]


@pytest.mark.parametrize("unit", ["<p title='x> don't \"", "<a ", "<div>", "<!", "</script", "<script></script", "<p>", "</b>", "<a href=\"x", "<a =\" ", "<", "&amp;"])
def test_very_long_broken_pages(unit):
    began = time.process_time()
    html.lines_of(unit * ((1 << 20) // len(unit)))
    assert time.process_time() - began < 5


def plain_texts(rows):
    """Text and number of shared lines by page: neighbours by path, the longest common subsequence by the full table."""
    out = {}
    lines = {n: html.lines_of(page) for n, _, page in rows}
    for n, url, _ in rows:
        host, path = url.split("/", 3)[2], "/" + url.split("/", 3)[3]
        others = sorted(("/" + u.split("/", 3)[3], m) for m, u, _ in rows if u.split("/", 3)[2] == host)
        at = others.index((path, n))

        def common(other):
            a, b = path.split("/"), other[0].split("/")
            return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        beside = [others[i] for i in (at - 1, at + 1) if 0 <= i < len(others)]
        mine = lines[n]
        gone = set()
        if beside:
            other = [t for t, _ in lines[max(beside, key=common)[1]]]  # the earlier one of equals
            table = [[0] * (len(other) + 1) for _ in range(len(mine) + 1)]
            for i in range(len(mine) - 1, -1, -1):
                for j in range(len(other) - 1, -1, -1):
                    table[i][j] = table[i + 1][j + 1] + 1 if mine[i][0] == other[j] else max(table[i + 1][j], table[i][j + 1])
            i = j = 0
            while i < len(mine) and j < len(other):
                if mine[i][0] == other[j]:
                    gone.add(i)
                    i, j = i + 1, j + 1
                elif table[i + 1][j] >= table[i][j + 1]:
                    i += 1
                else:
                    j += 1
        gone = {i for i in gone if not mine[i][1]}
        out[n] = ("\n\n".join(t for i, (t, main) in enumerate(mine) if main is not None and i not in gone), len(gone))
    return out


def test_pairing_and_deletion_equal_a_plain_version(spark):
    rng = random.Random(3)
    rows = []
    for n in range(60):
        menu = "".join(f"<li>Menu {i}</li>" for i in range(6) if rng.random() < 0.8)
        frame = "".join(f"<div>Frame {i}</div>" for i in range(8) if rng.random() < 0.6)
        text = f"<p>Own text of {n}</p>"
        text = f"<article>{text}<p>Said twice</p></article>" if n % 3 == 0 else text
        url = f"https://h{n % 2}.example/{rng.choice('ab')}/{rng.choice('cd')}/{n}"
        rows.append((n, url, f"<body><nav><ul>{menu}</ul></nav>{frame}{text}<footer><p>Foot</p></footer></body>"))
    got = {r.page_id: (r.text, r.n_shared) for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain_texts(rows)
    assert all(n > 0 for _, n in got.values())
