"""Quotation linking against a brute-force version, with wrapped, trimmed and nested quotations."""

import random
import re
import textwrap

from cohortlake.llm import quotes


def naive(messages):
    """(parent, root, depth, n_quoted, n_linked) of every (conversation, turn), message by message."""

    def words(line):
        return tuple(re.findall(r"\w+", line.lower()))

    def parts(text):
        out = []
        for line in (text or "").splitlines():
            m = re.match(r"\s{0,3}((?:>\s?)+)", line)
            level, rest = (m[1].count(">"), line[m.end() :]) if m else (0, line)
            if not out or out[-1][0] != level:
                out.append((level, []))
            out[-1][1].append(words(rest))
        return [(level, [w for w in own if w]) for level, own in out if any(own)]

    def pieces(own):
        flat = tuple(w for line in own for w in line)
        return {flat[i : i + 5] for i in range(max(1, len(flat) - 4))}

    result = {}
    for conv in {c for c, _, _ in messages}:
        own = sorted((t, parts(x)) for c, t, x in messages if c == conv)
        first = {}
        for t, p in own:
            for level, lines in p:
                if not level:
                    for piece in pieces(lines) | {w for w in lines if len(w) < 5}:
                        first.setdefault(piece, t)
        parent = {}
        for t, p in own:
            best, linked, quoted = None, set(), set()
            for level, lines in p:
                if not level:
                    continue
                quoted |= set(lines)
                need, votes = pieces(lines), {}
                for piece in need:
                    if first.get(piece, t) < t:
                        votes[first[piece]] = votes.get(first[piece], 0) + 1
                if votes:
                    held, source = max((n, s) for s, n in votes.items())
                    if 2 * held >= len(need):
                        linked |= set(lines)
                        best = max(best or (-99,), (-level, held, source))
            parent[t] = best[2] if best else None
            result[conv, t] = [parent[t], None, 0, len(quoted), len(linked)]
        for t in parent:
            root, depth = t, 0
            while parent[root] is not None:
                root, depth = parent[root], depth + 1
            result[conv, t][1:3] = root, depth
    return {k: tuple(v) for k, v in result.items()}


def threads(rng, conversations, length):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    out = []
    for conv in range(conversations):
        texts = []
        for turn in range(rng.randint(1, length)):
            lines = []
            for _ in range(rng.choice([0, 0, 1, 2])):
                if texts:
                    source = rng.choice(texts)
                    quoted = " ".join(source.split())
                    if rng.random() < 0.5:  # trimmed
                        quoted = " ".join(quoted.split()[rng.randint(0, 4) : rng.randint(5, 60)])
                    marks = "> " * rng.choice([1, 1, 2])
                    lines += [marks + x for x in textwrap.wrap(quoted.replace(">", ""), rng.choice([20, 40, 200])) or [""]]
            own = "\n".join(textwrap.wrap(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 4, 30]))), 50))
            text = "\n".join([*lines, own] if rng.random() < 0.7 else [own, *lines, own])
            texts.append(own or "thanks")
            out.append((conv, turn, rng.choice([text, text, text.upper()])))
    return out


def test_links_against_brute_force(spark):
    rng = random.Random(21)
    rows = threads(rng, 30, 12)
    df = spark.createDataFrame([(c, t, "r", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.n_quoted, r.n_linked) for r in quotes.link(df).collect()}
    want = naive(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 40


def test_wrapped_trimmed_and_nested(spark):
    long = "we should move the meeting to the larger hall because more people than expected have registered for it this year"
    rows = [
        (1, 0, f"Hello all,\n{long}\nRegards"),
        (1, 1, "Ok."),
        (1, 2, "On Monday, a wrote:\n" + "\n".join("> " + x for x in textwrap.wrap(long, 30)) + "\nAgreed, the small one is too narrow for us anyway."),
        (1, 3, "\n".join(">> " + x for x in textwrap.wrap(long, 25)) + "\n> Agreed, the small one is too\n> narrow for us anyway.\nThen let us book it."),
        (1, 4, "> the larger hall because more people than expected\nHow many?"),
        (1, 5, "> Ok.\nFine " + "word " * 60_000),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, text string, _quoted string, _at int")
    got = {r.turn: r for r in quotes.conversations(quotes.link(df)).collect()}
    assert [got[t].parent_turn for t in range(6)] == [None, None, 0, 2, 0, 1]
    assert got[2].body == "Agreed, the small one is too narrow for us anyway." and got[3].n_passages == 2 and got[3].n_confirmed == 1 and got[2].n_confirmed == 0
    assert [t for t in sorted(got, key=lambda t: got[t].position)] == [0, 2, 3, 4, 1, 5]
    assert got[0]["_quoted"] == "x" and got[0]["_at"] == 1


def test_one_long_thread_is_numbered_over_ranges(spark):
    rows = [(5, i, "r", (f"> number {i - 1} of this one long thread\n" if i else "") + f"number {i} of this one long thread") for i in range(120)]
    rows += [(None, i % 7, "r", "words") for i in range(50)]
    got = quotes.conversations(quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), parts=8).collect()
    assert all(r.position == r.turn for r in got if r.conv_id == 5)
    assert sorted(r.position for r in got if r.conv_id is None) == list(range(50))
