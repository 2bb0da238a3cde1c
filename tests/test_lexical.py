"""Lexemes, search syntax and cover density against published values and plain models."""

import itertools
import random

import pytest

from corvex.functions import lexemes as X
from corvex.operators import lexical as L

# Published pairs of words and their English stems.
STEMS = """consign consigned consigning consignment:consign consist consisted consisting consists consistent consistently consistency:consist consolation consolations:consol consolatory:consolatori
console consoled consoles consoling consolingly consols:consol consolidate consolidated consolidating:consolid consonant:conson consort consorted consorting:consort conspicuous conspicuously:conspicu
conspiracy conspiracies:conspiraci conspirator conspirators conspire conspired conspiring:conspir constable constables:constabl constance constancy:constanc constant:constant knack knacks:knack knackeries:knackeri
knag:knag knave knaves:knave knavish:knavish kneaded kneading:knead knee knees:knee kneel kneeled kneeling kneels:kneel knell:knell knelt:knelt knew:knew knick:knick knif:knif knife:knife knight knightly knights:knight
knit knits knitted knitting:knit knives:knive knob knobs:knob knock knocked knocking knocks:knock knocker knockers:knocker knopp:knopp knot knots:knot skies:sky dying:die news:news inning:inning generous generously:generous
cries cried:cri tie ties:tie gas:gas this:this kiwis:kiwi gaps:gap luxuriated:luxuri hopping:hop hoping hoped:hope falling:fall happy:happi say:say relational:relat national:nation rational:ration electrical electricity:electr
organization:organ feudalism:feudal hopefulness:hope analogous:analog analogy analogies:analog adoption:adopt replacement:replac communication:communic by:by yes:yes youth:youth boyish:boyish sensibility:sensibl fluently:fluentli"""


def test_stems():
    words: list[str] = []
    for part in STEMS.split():
        word, _, stem = part.partition(":")
        words.append(word)
        if stem:
            for w in words:
                assert X.stem(w) == stem, w
            words = []


def test_located():
    assert X.located("The Foxes, and a well-known fox@den.org of v2 3.14 running") == [
        ("fox", 2), ("well-known", 5), ("well", 6), ("known", 7), ("fox@den.org", 8), ("v2", 10), ("3.14", 11), ("run", 12)]
    assert X.located(None) == X.located("") == X.located("the of --- !") == []
    assert X.vector("fox foxes fox") == {"fox": [1, 2, 3]}


def written(search):
    return " | ".join(" & ".join(("!" if i["unwanted"] else "") + "<->".join(f"{w}@{o}" if o else w for w, o in zip(i["lexemes"], i["offsets"])) for i in b) for b in search)


@pytest.mark.parametrize("question, want", [
    ("The fat rats", "fat & rat"), ('"supernovae stars" -crab', "supernova<->star@1 & !crab"), ('"sad cat" or "fat rat"', "sad<->cat@1 | fat<->rat@1"),
    ('signal -"segmentation fault"', "signal & !segment<->fault@1"), ('""" )( dummy \\\\ query <->', "dummi & queri"), ('"the cat in the hat"', "cat<->hat@3"), ("or fat or", "fat"), ("fat or or rats", "fat | rat"),
    ("-the fat", "fat"), ("--fat", "fat"), ("fat - rat", "fat & !rat"), ("a of", ""), ("", ""), (None, ""), ('fat "rats', "fat & rat"), ("fat OR rat cats", "fat | rat & cat"), ("well-known", "well-known<->well@1<->known@2"), ("fat-", "fat"), ('"', ""),
])
def test_parse_search(question, want):
    assert written(L.parse_search(question)) == want


def plain_score(search, held):
    """Every span between two entries is tried; those that satisfy and hold no shorter one that does count."""
    if not L.satisfied(search, held):
        return None
    asked = {w for b in search for i in b for w in i["lexemes"]}
    entries = sorted({p for w in asked for p in held.get(w, ())})
    inside = lambda a, b: {w: [p for p in held.get(w, ()) if a <= p <= b] for w in asked}
    good = [(a, b) for a, b in itertools.combinations_with_replacement(entries, 2) if L.satisfied(search, inside(a, b))]
    least = [(a, b) for a, b in good if not any((c, d) != (a, b) and a <= c and d <= b for c, d in good)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p in entries) - 1)) for a, b in least)


def test_cover_density_is_that_of_all_spans():
    rng = random.Random(4)
    for _ in range(3000):
        held = {}
        for at in range(1, rng.randrange(2, 25)):
            held.setdefault(rng.choice("abcdxyz"), []).append(at)
        search = [[{"unwanted": False, "lexemes": (ws := rng.sample("abcd", rng.randrange(1, 3))), "offsets": [0, rng.randrange(1, 3)][: len(ws)]} for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 3))]
        got, want = L.cover_score(search, held), plain_score(search, held)
        assert (got is None) == (want is None) and (got is None or abs(got - want) < 1e-12), (search, held)


def test_cover_density_values():
    score = lambda q, t: L.cover_score(L.parse_search(q), X.vector(t))
    assert score("fat rat", "fat rat") == pytest.approx(0.1) and score("fat rat", "fat cow rat") == pytest.approx(0.05) and score("fat", "fat cow fat") == pytest.approx(0.2)
    assert score("fat rat", "fat cow") is None and score("fat -cow", "fat cow") is None and score("-cow", "fat") == 0
    assert score("fat or -cow rat", "fat big cow rat fat") == pytest.approx(0.2)  # the second branch holds nowhere


def test_search_equals_a_plain_model(spark):
    rng = random.Random(6)
    words = "running runs cats dog the of hat hats tied ties nation national relational fox-den".split()
    texts = [None, "", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(300)), "cat " * 3000 + "dog"]
    chunks = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "chunk_id long, content string, score string").repartition(5)
    forms = [lambda: rng.choice(words), lambda: '"' + " ".join(rng.sample(words, 2)) + '"', lambda: "-" + rng.choice(words), lambda: "or", lambda: '"', lambda: "-"]
    asked = [" ".join(rng.choice(forms)() for _ in range(rng.randrange(0, 5))) for _ in range(1000)] + [None, "-zebra", "zebra", "-cat -dog"]
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string").repartition(3)
    got = {(r.query_id, r.chunk_id): r.score for r in L.search(questions, L.index_chunks(chunks)).collect()}
    want, held = {}, [X.vector(t) for t in texts]
    for q, text in enumerate(asked):
        search = L.parse_search(text)
        for c, h in enumerate(held if search else ()):
            if (score := L.cover_score(search, h)) is not None:
                want[q, c] = round(score, 6)
    assert got.keys() == want.keys() and len({k[0] for k in want}) > 400
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_search_empty(spark):
    chunks = spark.createDataFrame([], "chunk_id long, content string")
    questions = spark.createDataFrame([(1, "fat"), (2, "-fat")], "query_id long, question string")
    assert L.search(questions, L.index_chunks(chunks)).count() == 0
    assert L.search(questions.where("false"), L.index_chunks(chunks)).count() == 0
