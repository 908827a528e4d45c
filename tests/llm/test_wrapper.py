import random
import time

import pytest

from chainloom.llm import common, wrapper


def node(tag, text="", *kids):
    made = wrapper.Node(tag, False, None)
    made.text, made.kids = text, list(kids)
    return made


def random_tree(rng, depth=4):
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
    return node(rng.choice("ab"), rng.choice(["", "x", "y"]), *kids)


def numbered(root):
    nodes = [root]
    for n in nodes:
        nodes += n.kids
    for i, n in enumerate(nodes):
        n.index = i
    for n in reversed(nodes):
        n.full = 1 + (n.text != "") + sum(k.full for k in n.kids)
    return root


def brute(a, b):
    """Weight of the best matching, by trying to leave out either last child or to match both."""
    if a.tag != b.tag:
        return 0

    def lists(x, y):
        if not x or not y:
            return 0
        both = brute(x[-1], y[-1])
        return max(lists(x[:-1], y), lists(x, y[:-1]), lists(x[:-1], y[:-1]) + both if both else 0)

    return wrapper.own_weight(a, b) + lists(a.kids, b.kids)


@pytest.mark.parametrize("seed", range(60))
def test_matching_equals_brute_force(seed):
    rng = random.Random(seed)
    a, b = numbered(random_tree(rng, 3)), numbered(random_tree(rng, 3))
    a.tag = b.tag
    found = wrapper.Matching(a, b)
    assert found.weight(a, b) == brute(a, b)
    # The matched pairs make up that weight, keep the order, and match each node once.
    pairs, work = [], [(a, b)]
    while work:
        x, y = work.pop()
        pairs.append((x, y))
        of = found.pairs(x, y)
        places = [(x.kids.index(p), y.kids.index(q)) for p, q in of]
        assert len({i for i, _ in places}) == len({j for _, j in places}) == len(places) and sorted(places) == sorted(places, key=lambda ij: ij[1])
        work += of
    assert sum(wrapper.own_weight(x, y) for x, y in pairs) == brute(a, b)
    assert wrapper.aligned(a, b) == {x.index: y.index for x, y in pairs}


def extracted(spark, rows):
    common.prepare(spark)
    return {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_deep_pages(spark):
    page = lambda n: "<div>" * 5000 + f"<p>deep {n}</p>" + "</div>" * 5000 + f"<p>flat {n}</p>"
    got = extracted(spark, [(n, "https://deep.example/", page(n)) for n in range(3)] + [(9, None, "<div>" * 5000 + "no end")])
    assert got == {**{n: f"deep {n}\nflat {n}" for n in range(3)}, 9: "no end"}


def test_long_pages_take_linear_time(spark):
    """20,000 blocks, in many articles too, against a pivot that shares their beginning."""
    blocks = lambda n, k: "".join(f"<p>line {i} of {n}</p>" for i in range(k))
    rows = [(n, "https://long.example/", f"<div>{blocks(0, 5)}</div><div>{blocks(n, 20)}</div>") for n in range(6)]
    rows += [(50, "https://long.example/", f"<div>{blocks(0, 5)}</div><div>{blocks(50, 20_000)}</div>")]
    rows += [(60, "https://other.example/", "".join(f"<article><p>part {i}</p></article>" for i in range(20_000)))]
    start = time.perf_counter()
    got = extracted(spark, rows)
    assert time.perf_counter() - start < 60
    assert got[50].count("\n") == 19_999 and "of 0" not in got[50] and got[60].count("\n") == 19_999 and got[3].count("\n") == 19


def test_linear_alignment_in_one_process():
    def seconds(k):
        page = wrapper.parse("<div>" + "".join(f"<p>own {i}</p>" for i in range(k)) + "</div>")[0]
        pivot = wrapper.parse("<div>" + "".join(f"<p>pivot {i}</p>" for i in range(40)) + "</div>")[0]
        start = time.perf_counter()
        wrapper.aligned(page, pivot)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.01)


def test_names_and_forms_leave_prose(spark):
    long = lambda n, what: " ".join(f"{what}{n}x{i}" for i in range(20))
    page = lambda n: (
        f"<form id='aspnetForm'><div id='search'><h2>Search methods</h2><p>{long(n, 'a')}</p></div><div class='promo-code-guide'><p>{long(n, 'b')}</p></div>"
        f"<div class='top-stories'><p>{long(n, 'c')}</p></div><div class='related-stories'><p>see {n}</p></div><div class='sidebar-left'><p>aside {n}</p></div>"
        f"<div id='footer'><p>foot {n}</p></div></form><form class='box'><label>Mail {n}</label><p>Write to us {n}</p></form>"
    )
    got = extracted(spark, [(n, "https://forms.example/", page(n)) for n in range(6)])
    assert got == {n: "\n".join(long(n, w) for w in "abc") for n in range(6)}  # the one heading is template
