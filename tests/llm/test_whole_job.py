"""Cases that a shortened method would miss."""

import random

import pytest

from tallyspark.llm import decontaminate, html_blocks, line_frequency, pseudonyms, size_aware_join


def article(rng, n=60):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def lines_of(words):
    return "\n".join(" ".join(words[k:k + 12]) for k in range(0, len(words), 12))


def test_lines_with_the_same_neighbours_are_boilerplate(docs):
    """A first line, a last line and a pair of lines that always stand together."""
    rng = random.Random(2)
    rows = [(k, f"Top of page\n{lines_of(article(rng))}\nleft part\nright part\n"
                f"{lines_of(article(rng))}\nAll rights reserved", "en", "host") for k in range(60)]
    got = line_frequency.judge(docs(rows)).collect()
    assert len(got) == 60 and all(r["n_lines_removed"] == 4 and r["kept"] for r in got)


def test_exact_copies_count_once(docs):
    """Sixty rows with one text show their lines once; of other rows each counts."""
    rng = random.Random(3)
    copied = "Top of page\n" + lines_of(article(rng, 240))
    rows = [(k, copied, "en", "host") for k in range(60)]
    rows += [(k, "Top of page\n" + lines_of(article(rng)), "en", "host") for k in range(60, 120)]
    got = line_frequency.judge(docs(rows)).collect()
    assert all(r["n_lines_removed"] == 1 and r["kept"] for r in got)


@pytest.mark.parametrize("shared,own,kept", [(1, 3, True), (2, 2, True), (3, 1, False), (19, 1, False)])
def test_boilerplate_of_any_share(docs, shared, own, kept):
    """A quarter, half, three quarters and nearly all of the text are the host's lines."""
    rng = random.Random(shared)
    common = [" ".join(article(rng, 12)) for _ in range(shared)]
    rows = [(k, "\n".join(rng.sample(common + [" ".join(article(rng, 12)) for _ in range(own)],
                                     shared + own)), "en", "host") for k in range(300)]
    rows += [(300 + k, lines_of(article(rng)), "en", "other") for k in range(30)]
    got = {r["doc_id"]: r for r in line_frequency.judge(docs(rows)).collect()}
    assert all(got[k]["n_lines_removed"] == shared and got[k]["n_words_removed"] == 12 * shared
               and got[k]["kept"] == kept for k in range(300))
    assert all(got[k]["n_lines_removed"] == 0 and got[k]["kept"] for k in range(300, 330))


@pytest.mark.parametrize("edits,most", [(3, 2), (1, 3)])
def test_pairs_grow_with_the_group(docs, monkeypatch, edits, most):
    """Copies of one text with a few other words each: too many for any two to link, or few
    enough to link with the text. The pairs that are read in full grow like the group."""
    check, read = size_aware_join.check_pairs, []
    monkeypatch.setattr(size_aware_join, "check_pairs", lambda pairs, *rest: (
        read.append(pairs.count()), check(pairs, *rest))[1])
    for n in (150, 300):
        rng = random.Random(n)
        text, rows = article(rng, 100), []
        for k in range(n):
            words = list(text)
            for at in rng.sample(range(2, 98), edits if k else 0):
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((k, " ".join(words)))
        read.clear()
        got = size_aware_join.join_classes(docs(rows)).collect()
        sets = {k: set(zip(w, w[1:], w[2:])) for k, w in ((k, t.split()) for k, t in rows)}
        near = {a: {b for b in sets if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
                for a in sets}
        for r in got:
            seen, todo = {r["doc_id"]}, [r["doc_id"]]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            assert r["component_id"] == min(seen)
        assert sum(read) <= most * n


def test_items_edited_at_the_limit_anywhere(docs, spark):
    """As many edits as are allowed: at the head, at the end, evenly, or anywhere, of any kind."""
    rng = random.Random(4)
    items = [(n, " ".join(article(rng, n))) for n in (5, 9, 10, 14, 15, 24, 37, 59)]
    rows, planted = [], {}
    for n, text in items:
        limit = n // 5
        places = {"head": list(range(limit)), "end": list(range(n - limit, n)),
                  "even": [k * n // limit for k in range(limit)]}
        places |= {f"any{k}": sorted(rng.sample(range(n), limit)) for k in range(4)}
        for at in places.values():
            for edit in ("replace", "delete", "insert", "mixed"):
                words = text.split()
                for k in reversed(at):
                    kind = rng.choice(["replace", "delete", "insert"]) if edit == "mixed" else edit
                    words[k:k + (kind != "insert")] = ["x%d" % rng.randrange(99)] * (kind != "delete")
                planted[len(rows), n] = limit
                around = [f"pad{rng.randrange(99)}" for _ in range(20)]
                rows.append((len(rows), " ".join(around[:10] + words + around[10:])))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs(rows), table).collect()}
    assert got.keys() == planted.keys()
    for pair, r in got.items():
        assert r["edits"] <= planted[pair] and 0 <= r["start"] <= 10 + planted[pair]


def test_windows_against_all_windows():
    rng = random.Random(5)
    for _ in range(200):
        item, text = (decontaminate.np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, top))],
                                             decontaminate.np.uint32) for top in (9, 20))
        each = [decontaminate.edit_distance(item, text[a:], len(item)) for a in range(len(text) + 1)]
        limit = rng.randrange(len(item) + 1)
        want = (min(each), each.index(min(each))) if min(each) <= limit else (limit + 1, 0)
        assert decontaminate.best_window(item, text, limit) == want


@pytest.mark.parametrize("text,values", [
    ("4111 1111 1111 1111 12/25", ["4111 1111 1111 1111"]),
    ("4111111111111111 123", ["4111111111111111"]), ("7 4111111111111111", ["4111111111111111"]),
    ("7 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    ("12 34 4111 1111 1111 1111 99", ["4111 1111 1111 1111"]),
    ("4111 1111 1111 1111 12 4012-8888-8888-1881 7", ["4111 1111 1111 1111", "4012-8888-8888-1881"]),
    ("4111 1111 1111 1111 12 12/25/2020", ["4111 1111 1111 1111", "12/25/2020"]),
    ("BE68 5390 0754 7034 BANK", ["BE68 5390 0754 7034"]),
    ("BE68539007547034 4111111111111111", ["BE68539007547034", "4111111111111111"]),
    ("AB12 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    ("token=9233A8ECF7C5D01B", ["9233A8ECF7C5D01B"]), ("key: 9233A8ecf7c5D01b", ["9233A8ecf7c5D01b"])])
def test_values_next_to_other_digits(text, values):
    for k in range(40):
        one, back = (pseudonyms.Replacer(b"k%d" % k, back=b) for b in (False, True))
        new, found = one.replace(f"x {text}.")
        assert sum(found.values()) == len(values) and len(new) == len(text) + 3
        assert not any(v in new for v in values)
        assert back.replace(new)[0] == f"x {text}."


def test_cards_in_a_long_row_of_numbers():
    rng = random.Random(6)
    groups = [str(rng.randrange(10 ** rng.randrange(1, 5))) for _ in range(3000)]
    for k in range(50, 3000, 100):
        groups[k:k + 4] = ["4111", "1111", "1111", "1111"]
    new, _ = pseudonyms.Replacer(b"k").replace(" ".join(groups))
    assert "4111 1111 1111 1111" not in new and len(new) == len(" ".join(groups))


def test_a_row_of_numbers_without_values_stays():
    for text in ("1234 5678 1234 5678 31/31/2020", "1234 5678 1234 5679 1", "AB12 1234 1234 1234 BANK"):
        assert pseudonyms.Replacer(b"k").replace(text) == (text, {})
    new, found = pseudonyms.Replacer(b"k").replace("1234 5678 1234 5678 12/25/2020")
    assert found == {"date": 1} and new.startswith("1234 5678 1234 5678 ")


@pytest.mark.parametrize("page,texts", [
    ("<html><head><title>t</title><meta x><style>s</style><body><p>a<p>b", ["a", "b"]),
    ("<head><title>t</title><div>a</div><p>b</p>", ["a", "b"]),
    ("<head><title>t</title></head><body><p>a</p></body>", ["a"]),
    ("<div><select><option>x</div><p>a</p>", ["x", "a"]),
    ("<div><svg></div><p>a</p><svg><g>no</g></svg><p>b</p>", ["a", "b"]),
    ("<body><object data=x><p>a</p><iframe src=y><p>b</p></body>", ["a", "b"]),
    ("<noscript><template><p>a</p>", ["a"]),
    ("<object>x<object>y</object>z</object><p>a</p>", ["a"]),
    ("<p>a <math><mi>x</mi><mo>=</mo><msup><mn>2</mn><mi>n</mi></msup></math> b</p>", ["a x=2n b"]),
    ("<p>a</p><script>x = '</p>'<p>b", ["a"])])
def test_unclosed_elements_lose_nothing(page, texts):
    assert [b.text for b in html_blocks.blocks_of(page)] == texts
