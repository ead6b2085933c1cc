"""Tree matching of pages with many blocks."""

import random
import time
import tracemalloc

import pytest

from callscope.llm import wrapper


def plain(x: list, y: list) -> int:
    """Simple tree matching as its definition says."""
    if x[0] != y[0]:
        return 0
    rows = [[0] * (len(y[2]) + 1)]
    for c in x[2]:
        row = [0]
        for j, d in enumerate(y[2]):
            row.append(max(row[j], rows[-1][j + 1], rows[-1][j] + plain(c, d)))
        rows.append(row)
    return rows[-1][-1] + 1


def tree(rng: random.Random, depth: int, most: int) -> list:
    return [rng.choice("abc"), "", [tree(rng, depth - 1, most) for _ in range(rng.randrange(most))] if depth else []]


def ranges(x: list) -> list[tuple[int, int, str]]:
    """Number, end and label of every node."""
    out: list = []

    def visit(node: list) -> None:
        at = len(out)
        out.append(None)
        for child in node[2]:
            visit(child)
        out[at] = (at, len(out), node[0])

    visit(x)
    return out


@pytest.mark.parametrize("cells", [1 << 21, 4])
def test_match_is_the_largest(monkeypatch, cells):
    monkeypatch.setattr(wrapper, "CELLS", cells)
    rng = random.Random(5)
    for n in range(400):
        depth, most = (1, 90) if n % 8 == 0 else (3, 6)
        a, b = tree(rng, depth, most), tree(rng, depth, most)
        a[0] = b[0] = "r"
        total, pairs = wrapper.match(a, b)
        assert total == plain(a, b) == len(pairs) == len(set(pairs))
        left, right = ranges(a), ranges(b)
        pairs.sort()
        for (i, j), (k, m) in zip(pairs, pairs[1:]):
            # Order and ancestors agree: both below the one before, or both after it.
            assert j < m and (k < left[i][1]) == (m < right[j][1])
        assert all(left[i][2] == right[j][2] for i, j in pairs)
    assert wrapper.match(["a", "", []], ["b", "", []]) == (0, [])


def page(rng: random.Random, size: int, irregular: bool) -> tuple[str, list[str]]:
    blocks, texts, length, n = [], [], 0, 0
    while length < size:
        for tag in ("h2", rng.choice(("p", "pre", "p")) if irregular else "p"):
            text = f"text {rng.randrange(10**9)} of block {n}"
            blocks.append(f"<{tag}>{text}</{tag}>")
            texts.append(text)
            length += len(blocks[-1])
            n += 1
    return f"<html><body><nav>Menu</nav><div class=top>Site</div>{''.join(blocks)}<div class=end>End</div></body></html>", texts


@pytest.mark.parametrize(("size", "irregular"), [(400_000, False), (4_000_000, False), (400_000, True), (4_000_000, True)])
def test_many_blocks(size, irregular):
    rng = random.Random(size)
    (mine, texts), (other, _) = (page(rng, int(size * part), irregular) for part in (1, 0.9))
    began = time.monotonic()
    pivot = wrapper.fold(wrapper.parse(other))
    template = [n for n, node in enumerate(wrapper.walk(pivot)) if node.label in ("div.top", "div.end")]
    outline = wrapper.json.dumps(wrapper.outline(pivot))
    tracemalloc.start() if size < 1_000_000 else None
    text = wrapper.extract_text(mine, outline, template)
    if size < 1_000_000:
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()
    assert text == "\n".join(texts)
    assert time.monotonic() - began < 60


def test_many_named_blocks_and_open_tags():
    began = time.monotonic()
    first = "a first line, longer than any note"
    blocks = f"<p>{first}</p>" + "".join(f"<div class='comment c{i}'>note {i}</div><p>line {i}</p>" for i in range(5000))
    kept = wrapper.extract_text(f"<body>{blocks}</body>", None, None)
    assert kept == first + "\n" + "\n".join(f"line {i}" for i in range(5000))
    assert wrapper.extract_text("<p>a</p><" + "b" * 200_000, None, None) == "a\n<" + "b" * 200_000
    assert time.monotonic() - began < 20


def test_forum_pages_of_unlike_posts():
    rng = random.Random(2)

    def post() -> str:
        return "<div class=post>" + "".join(f"<{t}>x{rng.randrange(10**6)}</{t}>" for t in rng.choices(("p", "pre", "blockquote"), k=rng.randrange(1, 6))) + "</div>"

    began = time.monotonic()
    a, b = (wrapper.outline(wrapper.fold(wrapper.parse("<body>" + "".join(post() for _ in range(n)) + "</body>"))) for n in (3000, 2500))
    total, pairs = wrapper.match(a, b)
    assert total == len(pairs) > wrapper.count_nodes(b) * 0.7
    assert time.monotonic() - began < 60
