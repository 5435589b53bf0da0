import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import attachment_kinds as kinds
from tessera.functions import parsing as P
from tessera.functions import text as T


def test_html_rules():
    html = """<html><head><title>no</title></head><body><p>One<br>two</p><script>x()</script><div style="display: none">hidden</div><div style="opacity:0">gone</div>
      <div style="opacity:0.5">seen</div><span hidden>h</span><span aria-hidden="true">h</span><img width="1" height="1px"><ul><li>a<li>b</ul><a href="http://x/unsubscribe?u">leave</a>
      <a href="http://y"><img src="i"></a><a href="http://z">kept</a><footer>foot</footer><table><tr><td>c1</td><td>c2</td></tr></table>&amp; &nbsp;end<p>Unsubscribe now</p></body></html>"""
    text = P.html_to_text(html)
    assert text.split("\n") == [x for x in text.split("\n") if "hidden" not in x]
    for there in ("One\ntwo", "seen", "- a", "- b", "kept", "c1 c2", "& end"):
        assert there in text, there
    for gone in ("no", "x()", "gone", "leave", "foot", "Unsubscribe"):
        assert gone not in text.split(), gone
    assert P.html_to_text(None) == "" and P.html_to_text("plain") == "plain"
    assert "deep" not in P.html_to_text("<div>" * 5000 + "deep")


def test_normalize_agrees_with_the_column_form(spark):
    cases = ["a  b", "﻿x​ y", "  a \t b \n\n\n\n c  ", "", "a\r\nb", "x͏y", "\n\n a"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(T.normalize(F.col("t"))).collect()] == [P.normalize_text(c) for c in cases]


def test_boilerplate_lines(spark):
    drop = ["© 2026 Acme", "(C) 2024", "View this email in your browser", "Manage your email preferences", "Help · Settings", "Orders ›", "Privacy Policy |", "see {{link}} here", "™ and © 2026"]
    keep = ["I read the web", "copyright law matters", "a sentence that goes on and on | with one bar and far too many words to be a row of links", "x > y holds, mostly", "on the web"]
    df = spark.createDataFrame([("\n".join([*drop, *keep]),)], "t string")
    assert df.select(T.strip_boilerplate(F.col("t"))).first()[0].split("\n") == keep
    assert [x for x in drop + keep if not P._BOILERPLATE.search(x)] == keep


def test_replies():
    assert P.trim_reply("mine\n> theirs\nOn Mon, A <a@x> wrote:\nold", "Re: x") == "mine"
    assert P.trim_reply("a\n-----Original Message-----\nb", None) == "a"
    block = "top\nFrom: A\nSent: now\n\nTo: B\nSubject: s\nold"
    assert P.trim_reply(block, "RE: s") == "top" and P.trim_reply(block, "Fwd: s").endswith("old")
    assert P.trim_reply("top\nFrom: A\nTo: B\nx", "Re: s").endswith("x") and P.trim_reply(None, None) == ""


def test_chunks():
    assert P.chunk_text(None) == [] and P.chunk_text("  short ") == ["short"]
    para = [f"{i} " + "x" * 300 for i in range(6)]
    out = P.chunk_text("\n\n".join(para))
    assert all(len(c) <= 800 + 128 + 2 for c in out) and out[1].startswith(out[0][-128:])
    long = "".join(chr(97 + i % 26) for i in range(2500))
    cut = P.chunk_text("intro\n\n" + long)
    assert cut[0] == "intro" and cut[1:] == [long[i : i + 800] for i in (0, 672, 1344, 2016)]
    assert sum(c.endswith(para[5]) for c in out) == 1
    with pytest.raises(ValueError):
        P.chunk_text("x", 100, 51)


def test_hard_split_column(spark):
    long = "ab😀" * 700
    df = spark.createDataFrame([(long,), ("x",), ("y" * 800,), ("z" * 801,)], "t string")
    out = [r[0] for r in df.select(T.hard_split(F.col("t"), 800, 672)).collect()]
    assert out[0] == [long[i : i + 800] for i in (0, 672, 1344)] and out[1] == ["x"] and len(out[2]) == 1 and len(out[3]) == 2


def test_calendar_and_card():
    ics = "BEGIN:VEVENT\r\nSUMMARY:Plan\\, now\r\nDESCRIPTION:long\r\n  line\\nnext\r\nLOCATION:Room\r\nDTSTART;TZID=X:2026\r\nORGANIZER;CN=\"Bo\":mailto:b@x\r\nATTENDEE:MAILTO:c@x\r\nEND:VEVENT"
    assert P.extract_calendar(ics) == "Plan, now\nlong line\nnext\nLocation: Room\nWhen: 2026\nOrganizer: Bo\nAttendee: c@x"
    card = "N:Doe;Jo;;Dr;\r\nORG:Acme;Unit\\;1\r\nADR:;;Street 1;City;;12;\r\nNOTE;ENCODING=QUOTED-PRINTABLE:caf=C3=A9\r\nPHOTO:zzz"
    assert P.extract_card(card) == "Org: Acme Unit;1\nAddress: Street 1, City, 12\ncafé\nDoe Jo Dr"
    assert P.extract_card("FN:Jo Doe\nN:Doe;Jo") == "Jo Doe"


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_and_statuses():
    docx = office({"word/document.xml": '<d xmlns:w="u"><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/></d>'})
    assert P.extract(docx, "docx") == ("One two", "done")
    pptx = office({"ppt/slides/slide10.xml": '<d xmlns:a="u"><a:p><a:t>ten</a:t></a:p></d>', "ppt/slides/slide2.xml": '<d xmlns:a="u"><a:p><a:t>two</a:t></a:p></d>'})
    assert P.extract(pptx, "pptx")[0] == "two\n\nten"
    xlsx = office({"xl/workbook.xml": '<w><sheet name="S1"/></w>', "xl/sharedStrings.xml": "<s><si><t>shared</t></si></s>", "xl/worksheets/sheet1.xml": '<w><c t="s"><v>0</v></c><c><v>42</v></c></w>'})
    assert P.extract(xlsx, "xlsx")[0] == "S1\nshared\n42"
    assert P.extract(b"no zip", "docx") == (None, "failed") and P.extract(b"  ", "text") == (None, "no_text") and P.extract(b"x", "pdf") == (None, "unsupported")
    assert P.extract(None, "text")[1] == "failed" and P.extract(b"x" * (P.MAX_ATTACHMENT + 1), "text")[1] == "oversize"
    assert P.decode_text("é".encode("cp1252"), None) == "é" and P.decode_text("д".encode("koi8-r"), "koi8-r") == "д" and P.decode_text("é".encode(), "iso-8859-1") == "é"


def test_mail():
    raw = b'Message-ID: <m1@x>\r\nReferences: <root@x> <p@x>\r\nFrom: =?utf-8?B?w4Fubg==?= <a@x.example>\r\nTo: B <b@x>, c@x\r\nSubject: =?utf-8?Q?Caf=C3=A9?=\r\nDate: Thu, 01 Jan 2026 10:00:00 +0200\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Hi</p><p>there</p>\r\n--b\r\nContent-Type: image/png\r\nContent-Disposition: inline\r\nContent-ID: <i>\r\n\r\nabc\r\n--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="a.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\nYWJj\r\n--b--\r\n'
    m = P.parse_message(raw)
    assert (m["message_id"], m["thread_id"], m["from_name"], m["from_address"], m["subject"]) == ("m1@x", "root@x", "Ánn", "a@x.example", "Café")
    assert m["body_text"] == "Hi\n\nthere" and [(a["part_index"], a["filename"], a["size_bytes"]) for a in m["attachments"]][0] == (0, "a.pdf", 3) and m["attachments"][1]["content_type"] == "image/png"
    bare = P.parse_message(b"Subject: x\r\n\r\nbody")
    assert bare["message_id"].endswith("@synthetic.local") and bare["thread_id"] == bare["message_id"] and bare["from_address"] is None


def test_scores():
    assert P.ocr_normalize("# **Tiﬁtle** [link](http://x) ![i](y) — “q” ½\n----") == "tifitle link q 1 2"
    assert P.word_error_rate("a b c", "a x c") == pytest.approx(1 / 3) and P.word_error_rate("", "x") == 1.0 and P.word_error_rate("", "") == 0.0
    assert P.edit_distance(list("kitten"), list("sitting")) == 3
    assert P.collapse_repeats("a\na\n\n\nb\na") == "a\n\n\nb\na"


def test_attachment_kinds(spark):
    rows = [("text/plain", "a.PDF", "pdf"), ("TEXT/CALENDAR", None, "calendar"), ("text/plain", "x.vcf", "vcard"), (None, "n.md", "text"), ("text/html", None, "text"), ("image/png", "a", "unsupported"), ("application/pdf", "x.ics", "pdf")]
    df = spark.createDataFrame(rows, "ct string, name string, want string")
    assert all(r[0] == r.want for r in df.select(kinds.attachment_format(F.col("ct"), F.col("name")), "want").collect())
    names = spark.createDataFrame([("/a/b.txt", None, "b.txt"), (None, "application/pdf", "attachment-3.pdf"), (" ", "x/y", "attachment-3"), ("a\0b", None, "a_b")], "name string, ct string, want string")
    assert all(r[0] == r.want for r in names.select(kinds.display_name(F.col("name"), F.col("ct"), F.lit(3)), "want").collect())


def test_truncation_keeps_whole_characters(spark):
    df = spark.createDataFrame([("😀" * 5,), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(T.truncate(F.col("t"), 4)).collect()] == ["😀" * 4 + "…", "abc", None]
