import random

from flowsieve.llm.wrappers import _longest_common, _pairs, align


def plain(left, right):
    """The same alignment by the whole table of lengths."""
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[i] == right[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def test_alignment_equals_the_whole_table():
    draw = random.Random(5)
    for _ in range(400):
        names = "abcdefghijklmnopqrst"[:draw.randint(1, 20)]
        left, right = ([draw.choice(names) for _ in range(draw.randint(1, 40))] for _ in range(2))
        assert _longest_common(left, right) == plain(left, right)


def test_long_sibling_lists_are_aligned_like_short_ones():
    draw = random.Random(6)
    left = ["a", *[draw.choice("pquvw") for _ in range(700)], "b"]
    right = ["c", *[draw.choice("pquvw") for _ in range(650)], "d"]
    got = _pairs([[x] for x in left], [[x] for x in right])
    assert got == plain(left, right)
    assert sum(i is not None and j is not None for i, j in got) > 300


def test_one_more_element_leaves_a_long_list_aligned():
    kid = lambda name: [name, [], 0, 0]
    names = [f"n{i}" for i in range(3000)]
    left = ["body", [kid("x"), *[kid(n) for n in names], kid("y")], 0, 0]
    right = ["body", [kid("z"), *[kid(n) for n in names], kid("w")], 0, 0]
    kids = align(left, right)[1]
    assert [k[0] for k in kids if not k[2]] == names
    assert sorted(k[0] for k in kids if k[2]) == ["w", "x", "y", "z"]
