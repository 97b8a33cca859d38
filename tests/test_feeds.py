"""Atom feeds with defects."""

from quillscreen.sources import feeds

FEED = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>results</title>
<entry><id>http://arxiv.org/abs/2401.00001v3</id><title> One
   title </title><summary>Text &amp; more &lt;b&gt;</summary><published>2024-01-02T00:00:00Z</published><author><name>A B</name></author><author><name>C</name></author>
<arxiv:doi xmlns:arxiv="http://arxiv.org/schemas/atom">10.1/X.</arxiv:doi><category term="cs.DL"/><category term="cs.IR" scheme="s"/></entry>
<entry><id>http://arxiv.org/abs/cond-mat/9901001</id><title>Old</title></entry>
<entry><id>http://arxiv.org/abs/2401.00002</id><title>Crossed</summary></entry>
<entry><title>Nameless</title></entry>
<entry><id>http://arxiv.org/abs/2401.00003</id><title> </title><published>soon</published></entry>
<entry><id>http://arxiv.org/abs/2401.00004v1</id><title>Undated</title><published>soon</published></entry>
</feed>"""


def test_good_entries_are_papers_and_others_are_kept_aside(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FEED)
    good, bad = feeds.read(spark, str(tmp_path))
    papers = {r.paper_id: r for r in good.collect()}
    assert set(papers) == {"arxiv:2401.00001", "arxiv:9901001", "arxiv:2401.00004"}
    one = papers["arxiv:2401.00001"]
    assert (one.title, one.abstract, one.authors, one.year, one.doi, one.fields_of_study, one.publication_date) == ("One title", "Text & more <b>", ["A B", "C"], 2024, "10.1/x", ["cs.DL", "cs.IR"], "2024-01-02")
    assert papers["arxiv:9901001"].authors == [] and papers["arxiv:9901001"].abstract == "" and papers["arxiv:2401.00004"].year is None
    defects = sorted((r.defect, "2401.00002" in r.entry, "Nameless" in r.entry) for r in bad.collect())
    assert defects == [("malformed", True, False), ("no id", False, True), ("no title", False, False)]


def test_no_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed><title>nothing</title></feed>")
    good, bad = feeds.read(spark, str(tmp_path))
    assert good.collect() == [] and bad.collect() == []
