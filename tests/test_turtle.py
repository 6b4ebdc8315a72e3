"""Turtle by blocks: the same triples as from one parser over the whole text."""

import random

import pytest

from tessera.sources import files, turtle

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def test_nested_terms():
    text = """@prefix : <x:> . :s :p [ :q :a , "b" ; a :T ; ] , ( 1 [ ] ( ) ) . [ :r :s ] . [] :t 'it''s' ."""
    with pytest.raises(ValueError):
        list(turtle.turtle_triples(text))
    got = list(turtle.turtle_triples(text.replace("'it''s'", "'it\\'s'")))
    assert got == [
        ("x:s", "x:p", "_:b1"), ("_:b1", "x:q", "x:a"), ("_:b1", "x:q", "b"), ("_:b1", RDF + "type", "x:T"),
        ("x:s", "x:p", "_:b3"), ("_:b3", RDF + "first", "1"), ("_:b3", RDF + "rest", "_:b4"), ("_:b4", RDF + "first", "_:b2"),
        ("_:b4", RDF + "rest", "_:b5"), ("_:b5", RDF + "first", RDF + "nil"), ("_:b5", RDF + "rest", RDF + "nil"),
        ("_:b6", "x:r", "x:s"), ("_:b7", "x:t", "it's"),
    ]
    for bad in (":a", "<a:a> <a:b> [ <a:c> ] .", "<a:a> <a:b> ( 1 .", "<a:a> <a:b> 1 ; ; . .", "<a:a> [ ] <a:b> .", "( 1 ) ."):
        with pytest.raises(ValueError):
            list(turtle.turtle_triples(bad))


def written(rng, n):
    """Statements over many lines, with full stops, quotes and comments where they mean nothing."""
    out = ["@prefix : <http://x.org/> .", "PREFIX r: <http://r.org/#>"]
    for i in range(n):
        kind = rng.randrange(6)
        if i == n // 2:
            out.append("@prefix r: <http://later.org/#> . # from here on")
        if kind == 0:
            out.append(f":s{i} r:p :o{i} ;\n   r:q \"one. # no comment\" . # :c r:d :e .")
        elif kind == 1:
            out.append(f':s{i} r:text """long\n text . with "quotes" .\n# and more\n \\"""" , \'\'\'and """ so on .\n.\n\'\'\' .')
        elif kind == 2:
            out.append(f":s{i}\n r:p [\n r:inner [ r:deep {i} ] ;\n r:list ( :a\n :b ( {i} ) )\n ] .")
        elif kind == 3:
            out.append(f":s{i} a r:T . :t{i} r:p 1.5 .")
        elif kind == 4:
            out.append(f"[] r:p <http://dot.org/a.b#c> ;\n\n  r:q 'x.y' , true .")
        else:
            out.append(f"# a comment with \"\"\" and a stop .\n:s{i} r:p 3 .")
    return "\n".join(out) + "\n"


def blind(triples):
    """Unnamed nodes by what is said of them, so that their names don't matter."""
    triples, known = list(triples), {}
    unnamed = lambda x: x.startswith("_:")
    for _ in range(6):
        about = {}
        for s, p, o in triples:
            if unnamed(s):
                about.setdefault(s, []).append((p, known.get(o, "?") if unnamed(o) else o))
        known = {k: str(sorted(v)) for k, v in about.items()}
    return sorted(tuple(known.get(x, "[]") if unnamed(x) else x for x in t) for t in triples)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_give_the_same_triples(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts = [written(rng, 60), written(rng, 5), "", "# nothing\n"]
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.ttl").write_text(t)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert spark.read.text(str(tmp_path / "f0.ttl")).rdd.getNumPartitions() > 4
        got = [tuple(r) for r in files.read_turtle(spark, str(tmp_path)).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [t for k, x in enumerate(texts) for t in turtle.turtle_triples(x, blank=lambda i, k=k: f"_:{k}-{i}")]
    assert len(want) > 150 and blind(got) == blind(want)
    assert len({x for t in got for x in t if x.startswith("_:")}) == len({x for t in want for x in t if x.startswith("_:")})


def test_lines_and_states():
    assert turtle.line_state(':a :b "x" . # c', 0) == (0, True)
    assert turtle.line_state(':a :b """x . ', 0) == (1, False)
    assert turtle.line_state('y""" .', 1) == (0, True)
    assert turtle.line_state("y\\''' . ''' , ", 2) == (0, False)
    assert turtle.line_state('# """', 0) == (0, False) and turtle.line_state("<http://x/#y> .", 0) == (0, True)
