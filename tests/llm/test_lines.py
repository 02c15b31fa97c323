"""Line dedup: which templates recur."""

import random

from gridlens.llm import lines


def left(spark, texts, **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r.text for r in lines.clean(docs, **settings).orderBy("doc_id").collect()]


def own_line(rng):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(9))


def test_blocks_of_lines_recur(spark):
    """Every line of a block stands in all documents, whatever its neighbours hash to."""
    rng = random.Random(1)
    for size, own in ((10, 5), (20, 5), (3, 2)):
        blocks = [[own_line(rng) for _ in range(size)] for _ in range(8)]
        bodies = [(b, [own_line(rng) for _ in range(own)]) for b in blocks for _ in range(6)]
        assert left(spark, ["\n".join(b + body) for b, body in bodies]) == ["\n".join(body) for _, body in bodies]


def test_copies_have_no_weight(spark):
    """A copied or repetitive document counts once: for the recurrence of a template and for the tokens of a leaf."""
    rng = random.Random(2)
    footer, other = "all the rights of this page are reserved", "see the list of our partners for more"
    bodies = [own_line(rng) for _ in range(8)]
    copied = own_line(rng) + "\n" + footer
    texts = [b + "\n" + footer for b in bodies] + [copied] * 30
    family = [own_line(rng) + "\nclick here to follow %s today" % x for x in ("anna", "ben", "carl", "dora", "emil", "fred")]
    repeats = own_line(rng) + "\nclick here to read more now" * 30
    got = left(spark, [*texts, *family, repeats, other])
    assert got[:8] == bodies and {t.count("\n") for t in got[8:38]} == {0}
    assert all("click" not in t for t in got[38:44])
    assert got[44:] == [repeats, other]


def test_each_family_of_a_leaf_has_its_template(spark):
    """Two families with equal shares, and one beside a line that stands in far more documents."""
    rng = random.Random(3)
    names = [own_line(rng).split(" ")[0] for _ in range(20)]
    even = ["please share this page of %s with friends" % x for x in names] + ["please share this list for %s by mail" % x for x in names]
    hot = ["click here to read more now"] * 30 + ["click here to follow %s today" % x for x in names]
    prose = ["we saw that " + own_line(rng) for _ in range(12)]
    bodies = [own_line(rng) for _ in range(len(even) + len(hot))]
    assert left(spark, [b + "\n" + x for b, x in zip(bodies, even + hot)] + prose) == bodies + prose


def test_lines_of_any_length(spark):
    """A long passage with a varying name, a line of one word, and lines of a script without blanks."""
    rng = random.Random(5)
    names = [own_line(rng).split(" ")[0] for _ in range(7)]
    passage = " ".join(own_line(rng) for _ in range(12))
    kinds = [["in short " + passage.replace(" ", " %s " % x, 40) for x in names], ["Les."] * 7, ["版权所有%s本站保留一切权利转载请注明出处" % x for x in "赵钱孙李周吴郑"]]
    bodies = [own_line(rng) for _ in range(7)]
    assert left(spark, ["\n".join([b, *x]) for b, *x in zip(bodies, *kinds)]) == bodies
    apart = ["2%03d" % k for k in range(7)] + ["第%d章" % k + x * 4 for k, x in enumerate("天地玄黄宇宙洪")]
    assert left(spark, [b + "\n" + x for b, x in zip(bodies * 2, apart)]) == [b + "\n" + x for b, x in zip(bodies * 2, apart)]
