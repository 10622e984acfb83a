"""Declared languages and registered names of pages."""

from foliant.llm import langid

HOSTS = {"www.web.de": "web.de", "mail.web.de": "web.de", "a.b.co.uk": "b.co.uk", "x.info.pl": "x.info.pl", "www.info.de": "info.de", "press.fr": "press.fr", "a.press.fr": "press.fr", "www.gouv.fr": "www.gouv.fr", "b.asso.fr": "b.asso.fr", "www.or.at": "www.or.at", "shop.example.com.au": "example.com.au", "localhost": "localhost"}
DECLARED = {'<html data-lang="fr" lang="de">': "de", "<html lang=fr>": "fr", '<html class="x lang" xml:lang="es">': "", "<HTML\nLANG='en-GB' data-lang=\"de\">": "en", "<html data-lang='de'>": "", "<htmlx lang=de>": ""}


def test_hosts_and_declarations(spark):
    docs = spark.createDataFrame([(i, f"{w} words of language {lang} in a row", lang) for i, (lang, w) in enumerate((x, y) for x in ("de", "en", "es", "fr") for y in ("some", "other"))], "doc_id long, text string, lang string")
    model = langid.fit_text_model(docs, 10)
    pages = [(i, f"http://{h}/p", "<html>") for i, h in enumerate(HOSTS)] + [(100 + i, "http://x.de/", h) for i, h in enumerate(DECLARED)]
    found = {r["page_id"]: r for r in langid.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"), model, 300).collect()}
    assert {h: found[i]["domain"] for i, h in enumerate(HOSTS)} == HOSTS
    assert {h: found[100 + i]["declared"] for i, h in enumerate(DECLARED)} == DECLARED
