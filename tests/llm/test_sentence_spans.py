import random

from adyield.llm import sentence_spans as s
from adyield.llm.common import Words

from .helpers import FOLD, PROSE, WORD, documents, odd_rows, with_clashes


def sentences(text):
    """Plain walk over the letters: a sentence ends behind ASCII stops with closing quotes before white space, and behind
    line ends; white space stays with what it follows, at the start with the first sentence."""
    out, at, i, n = [], 0, len(text) - len(text.lstrip()), len(text)
    while i < n:
        j = i
        if text[i] == "\n":
            j = i + 1
        elif text[i] in ".!?":
            j = i
            while j < n and text[j] in ".!?":
                j += 1
            while j < n and text[j] in "\"')]":
                j += 1
            j = j if j < n and text[j].isspace() else i
        if j > i:
            while j < n and text[j].isspace():
                j += 1
            out.append(text[at:j])
            at = i = j
        else:
            i += 1
    return out + [text[at:]] * (at < n)


def units_of(text):
    """Sentences; of long ones, every word that has the least hash of some window (the last of equal ones) begins a unit."""
    out = []
    for sentence in sentences(text):
        words = list(WORD.finditer(sentence))
        if len(words) <= s.MAX_WORDS:
            out.append(sentence)
            continue
        h = Words([sentence]).hash.tolist()
        first = set()
        for a in range(len(words) - s.WINDOW + 1):
            first.add(max(range(a, a + s.WINDOW), key=lambda k: (-h[k], k)))
        edges = [0, *sorted(words[k].start() for k in first if k), len(sentence)]
        out += [sentence[a:b] for a, b in zip(edges, edges[1:])]
    return out


def brute(rows):
    """doc_id -> text after removal, by plain comparison of word runs; ids distinct, texts of scripts with blanks."""
    def found(text):
        units = units_of(text or "")
        words = [WORD.findall(u.translate(FOLD)) for u in units]
        upto = [0]
        for w in words:
            upto.append(upto[-1] + len(w))
        enough = lambda a, b: b - a >= s.MIN_UNITS and upto[b] - upto[a] >= s.MIN_WORDS
        n, spans = len(units), set()
        for a in range(n):
            spans |= {(a, b) for b in [next((b for b in range(a + 1, n + 1) if enough(a, b)), None)] if b}
            spans |= {(b, a + 1) for b in [next((b for b in range(a, -1, -1) if enough(b, a + 1)), None)] if b is not None}
        out = [(a, b, tuple(w for u in words[a:b] for w in u)) for a, b in sorted(spans)]
        return units, out

    seen, result = set(), {}
    for d, text in sorted(rows):
        units, runs = found(text)
        gone, own = set(), set()
        for a, b, run in runs:
            if run in seen or run in own:
                gone |= set(range(a, b))
            own.add(run)
        seen |= own
        result[d] = "".join(u for i, u in enumerate(units) if i not in gone) if text is not None else None
    return result


def test_units_are_sentences(small):
    for t in [r["text"] for r in small("documents").collect()] + ["a.b c!\n\nd, e", ".", "\n", "One, two: three; four. (Five.) Six?", " \n a. b"]:
        assert s.cut(t) == units_of(t)


def test_units_join_to_the_text(small):
    for t in [r["text"] for r in small("documents").collect()] + [t or "" for _, t, _, _ in odd_rows()] + ["a.b c!\n\nd, e", ".", "\n"]:
        assert "".join(s.cut(t)) == t


def test_matches_brute_force_on_documents(small):
    df = small("documents")
    got = {r["doc_id"]: r["text"] for r in s.dedup(df).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_passage_goes_from_all_but_the_first(spark):
    texts = [(d, f"intro number {d} is its own. {PROSE} closing words {d} of this text here.", "en", "a") for d in range(1, 30)]
    got = {r["doc_id"]: r["text"] for r in s.dedup(documents(spark, texts)).collect()}
    assert PROSE.strip().split(". ")[-2] in got[1]
    for d in range(2, 30):
        assert "it rained for a week" not in got[d] and f"intro number {d}" in got[d] and f"closing words {d}" in got[d]


def test_unique_text_is_untouched(spark):
    text = "Nothing in here is said twice, as far as anybody knows. Each clause is new; each word has its place."
    shared = "In short, as has been said before, and will be again, all of this is so."
    rows = [(1, text, "en", "a"), (2, PROSE, "en", "a"), (3, f"{shared} {text[::-1]}", "en", "a"), (4, f"{made(3, 40)}. {shared} {made(4, 9)}", "en", "a")]
    got = {r["doc_id"]: r["text"] for r in s.dedup(documents(spark, rows)).collect()}
    assert got[1] == text and got[3] == rows[2][1] and got[4] == rows[3][1]      # one sentence with commas is no passage


def test_odd_tables(spark):
    df = with_clashes(documents(spark, odd_rows()))
    out = s.dedup(df)
    rows = out.collect()
    assert len(rows) == len(odd_rows()) and set(out.columns) == set(df.columns) | {"n_units", "n_removed"}
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (8, None)}
    assert by[1]["n_removed"] == 0                       # a sentence said three times is shorter than a passage
    assert by[2]["text"].strip() == "" and by[3]["text"] is None and by[4]["text"] == ""
    assert by[6]["n_removed"] == 0
    kept = s.without_repeats(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 2 not in ids and 3 in ids and 1 in ids
    assert s.dedup(documents(spark, [])).count() == 0


def windows(text, k=50):
    words = WORD.findall((text or "").translate(FOLD))
    return {tuple(words[i: i + k]) for i in range(len(words) - k + 1)}


def made(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def assert_no_window_stays(spark, texts, k=50):
    """No k words of a text are left in a later one, by plain comparison."""
    got = {r["doc_id"]: r["text"] for r in s.dedup(documents(spark, [(d, t, "en", "a") for d, t in texts])).collect()}
    seen = set()
    for d, text in sorted(texts):
        assert not windows(got[d], k) & seen
        seen |= windows(text, k)
    return got


def test_repeated_paragraphs_between_blank_lines_go(spark):
    paragraphs = [made(i, 20 + i) for i in range(6)]
    for between in ("\n\n", "\n \t\n\n", '."\n\n'):
        texts = [(d, "\n\n" + between.join([made(100 + d, 30), *paragraphs, made(200 + d, 30)]) + "\n\n") for d in range(1, 5)]
        got = assert_no_window_stays(spark, texts)
        assert got[1] == texts[0][1]
        for d in range(2, 5):
            assert not any(p in got[d] for p in paragraphs)
            assert made(100 + d, 30) in got[d] and made(200 + d, 30) in got[d]


def test_passages_without_ascii_stops_go(spark):
    """Unpunctuated, pasted into running text, closed by quotes, and in other scripts."""
    def letters(seed, n, first, size, between="", stop="", each=7):
        rng = random.Random(seed)
        return "".join(chr(first + rng.randrange(size)) + (stop if i % each == each - 1 else between) for i in range(n))

    passages = {
        "plain": made(1, 60), "quoted": " ".join(made(i, 9) + '."' for i in range(10, 17)),
        "danda": " ".join("".join(chr(0x915 + ord(c) - 97) for c in w) for w in made(2, 60).split()),
        "arabic": "؟ ".join(" ".join("".join(chr(0x628 + ord(c) % 18) for c in w) for w in made(i, 11).split()) for i in range(30, 36)),
        "han": letters(3, 120, 0x4E00, 3000, stop="。", each=13), "han, no stop": letters(4, 120, 0x4E00, 3000),
        "thai": letters(5, 160, 0x0E01, 44)}
    texts, own = [], {}
    for k, (name, passage) in enumerate(passages.items()):
        blank = "" if name.startswith(("han", "thai")) else " "
        for d in range(10 * k, 10 * k + 3):
            own[d] = letters(50 + d, 40, 0x4E00, 3000) if blank == "" else made(50 + d, 40)
            texts.append((d, own[d] + blank + passage + blank + own[d][::-1]))
    got = assert_no_window_stays(spark, texts)
    for k, (name, passage) in enumerate(passages.items()):
        assert got[10 * k] == texts[3 * k][1], name
        for d in (10 * k + 1, 10 * k + 2):
            # of scripts written without blanks 50 letters, of the others 50 words
            n = 50 if name.startswith(("han", "thai")) else len(passage)
            assert not any(passage[i: i + n] in got[d] for i in range(len(passage) - n + 1)), name
            assert got[d].startswith(own[d]) and got[d].endswith(own[d][::-1]), name


def test_every_row_is_a_document(spark):
    """Rows without id or with one id lose what another of them holds; of equal rows one keeps its text."""
    passage, lone = made(1, 70), made(2, 40)
    for i in (None, 7):
        rows = [(i, f"{made(10 + k, 20)}. {passage}. {made(30 + k, 20)}.", "en", "a") for k in range(5)] + [(i, lone, "en", "a")] * 3
        got = [r["text"] for r in s.dedup(documents(spark, rows)).collect()]
        assert len(got) == len(rows)
        assert sum(passage in t for t in got) == 1 and sum(bool(windows(t) & windows(passage)) for t in got) == 1
        assert sorted(t for t in got if t in (lone, "")) == ["", "", lone]
        for k in range(5):
            assert sum(made(10 + k, 20) in t and made(30 + k, 20) in t for t in got) == 1
    mixed = [(3, passage, "en", "a"), (None, passage, "en", "a"), (3, lone, "en", "a"), (1, passage + ". " + made(5, 20), "en", "a")]
    got = {(r["doc_id"], r["n_removed"] > 0) for r in s.dedup(documents(spark, mixed)).collect()}
    assert got == {(1, False), (3, True), (3, False), (None, True)}
