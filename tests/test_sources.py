import http.server
import io
import json
import shutil
import threading

import pytest

from quarry import models
from quarry.cli import main, questions, rendered
from quarry.plans import evidence
from quarry.plans.evidence import Checked, Models
from quarry.sources import config, files
from quarry.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "kb"
    (at / "sub").mkdir(parents=True)
    (at / "a.md").write_text("# Fees\n\nThe transfer fee is 2,50% for code ABC12-X.\n")
    (at / "sub" / "b.md").write_text("Opening hours are nine to five. " * 60)
    (at / ".h.md").write_text("hidden")
    (at / "_u.md").write_text("hidden")
    (at / "C.MD").write_text("upper")
    (at / "empty.md").write_text("   \n")
    (at / "p.pdf").write_bytes(b"good")
    (at / "bad.pdf").write_bytes(b"bad")
    return at


def stand_ins():
    """A parser and an embedder that travel to the workers by value."""

    def parse(content):
        if content == b"bad":
            raise ValueError("no pdf")
        word = lambda t, x, y: {"text": t, "x0": x, "top": y, "x1": x + 1, "bottom": y + 1}
        table = ({"x0": 50.0, "top": 50.0, "x1": 90.0, "bottom": 90.0}, [["Rate", "Value"], ["loan", None]])
        return [([word("loan", 0.0, 1.0), word("terms", 5.0, 2.0), word("Rate", 55.0, 55.0)], [table]), ([], [])]

    def embed(texts):
        out = []
        for t in texts:
            v = [float(t.lower().count(w)) + 0.01 for w in ("fee", "hours", "loan")]
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v])
        return out

    return parse, embed


parse, embed = stand_ins()


def settings(folder, tmp_path, **more):
    return config.Settings([str(folder), str(folder / "missing")], str(tmp_path / "index"), **more)


def test_listing_and_markdown(spark, folder):
    got = files.listing(spark, [str(folder), "/nowhere"]).orderBy("kind", "path").collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["kind"]) for r in got] == [(".h.md", "md"), ("_u.md", "md"), ("a.md", "md"), ("empty.md", "md"), ("b.md", "md"), ("bad.pdf", "pdf"), ("p.pdf", "pdf")]
    assert {r["knowledge_base"] for r in got} == {"kb"}
    docs = files.markdown(spark, str(folder), plain=True).collect()
    assert len(docs) == 5 and sum(r["text"] == "hidden" for r in docs) == 2 and any(r["text"].startswith("Fees") for r in docs) and all(r["page"] is None for r in docs)


def test_pdf_pages_and_errors(spark, folder):
    pages = files.pdf_pages(spark, str(folder), parse)
    assert [r["error"] for r in pages.where("error IS NOT NULL").collect()] == ["ValueError: no pdf"]
    docs = files.pdf_documents(pages).collect()
    assert [(r["page"], r["text"]) for r in docs] == [(1, "loan terms\n\n| Rate | Value |\n|---|---|\n| loan |  |")]


def test_build_check_ask_report(spark, folder, tmp_path):
    models = Models(embed=embed, verify=lambda q, t: "ya" if "fee" in t else "tidak", answer=lambda q, e: f"{len(e)} source(s)", paraphrase=lambda q, n: "- cost of a transfer\n\n- charges")
    s = settings(folder, tmp_path, chunk_size=200, chunk_overlap=20)
    with pytest.raises(config.IndexMissing):
        evidence.check(spark, s, "fee?")
    assert evidence.build(spark, s, models, parse) == evidence.Metrics(5, 2, evidence.opened(spark, s.index).chunks.count())
    got = evidence.check(spark, s, "transfer fee", models)
    assert [e["file"] for e in got.evidence] == ["a.md"] and got.answer == "1 source(s)"
    assert evidence.check(spark, s, "transfer fee", Models(verify=lambda q, t: 1 / 0)) == Checked([], None)
    broken = evidence.check(spark, s, "transfer fee", Models(answer=lambda q, e: 1 / 0, paraphrase=lambda q, n: 1 / 0))
    assert broken.answer.startswith("[ERROR]") and broken.evidence
    answer, sources = evidence.ask(spark, s, "hours", models)
    assert answer == "4 source(s)" and "[kb] b.md" in sources
    evidence.report(spark, s, "opening hours", "b.md", str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 5


def test_nothing_to_index(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert evidence.build(spark, settings(tmp_path / "none", tmp_path)) is None
    assert not (tmp_path / "index").exists()


def test_rewrites_are_guarded(spark):
    docs = spark.createDataFrame([("s", 1, "k", "fee 5%"), ("s", 2, "k", "code AB12"), ("s", 3, "k", "boom"), ("s", 4, "k", None)], files.DOCUMENT)

    def reformat(t):
        if t == "boom":
            raise ValueError
        return f"# {t}" if "%" in t else "lost"

    assert [r["text"] for r in evidence.reformatted(docs, reformat).orderBy("page").collect()] == ["# fee 5%", "code AB12", "boom", None]


def test_variants():
    m = Models(paraphrase=lambda q, n: "- satu\n\n-\n- dua\n- tiga", synonyms={"Valas": ["forex", "fx"], "bunga": ["rate"], "x": ["y"]})
    s = config.Settings([], "", paraphrases=2)
    assert evidence.variants("bunga VALAS", s, m) == ["bunga VALAS", "bunga VALAS forex fx rate", "satu", ""]
    assert evidence.variants("q", config.Settings([], "", paraphrases=0), m) == ["q"]


def test_stream_adds_once(spark, folder, tmp_path):
    s = settings(folder, tmp_path)
    for _ in range(2):
        ingest.follow(spark, s, str(folder), str(tmp_path / "cp")).awaitTermination()
    first = spark.read.parquet(s.index + "/chunks")
    n = first.count()
    assert n and first.select("chunk_id").distinct().count() == n
    evidence.index_chunks(spark, s.index, Models())
    assert evidence.check(spark, s, "opening hours").evidence


def test_append_makes_a_broken_call_whole(spark, folder, tmp_path):
    s, m = settings(folder, tmp_path), Models(embed=embed)
    docs = files.markdown(spark, str(folder))
    n = evidence.append(spark, s.index, docs, s, m)
    for table in ("chunks", "embeddings"):  # the other table's write was lost
        shutil.rmtree(tmp_path / "index" / table)
        evidence.append(spark, s.index, docs, s, m)
        ids = [[r[0] for r in spark.read.parquet(f"{s.index}/{t}").select("chunk_id").collect()] for t in ("chunks", "embeddings")]
        assert sorted(ids[0]) == sorted(ids[1]) and len(set(ids[0])) == len(ids[0]) == n
    assert evidence.append(spark, s.index, docs, s, m) == 0


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    at = tmp_path / "config.yaml"
    at.write_text(f"llm_config: {{api_key: k}}\nvectorstore_config: {{persist_directory: {tmp_path}/index}}\ndocument_folders: [{folder}]\nchunking_config: {{}}\nretrieval_config: {{}}\n")
    with pytest.raises(SystemExit):
        main(["check", "--config", str(at)])
    assert main(["check", "fee", "--config", str(at)]) == 2
    assert main(["build", "--config", str(at)]) == 0 and main(["check", "transfer fee", "--config", str(at)]) == 0
    assert "a.md" in capsys.readouterr().out
    assert main(["ask", "fee", "--config", str(at)]) == 2 and "embedder" in capsys.readouterr().err
    m = Models(embed=embed, answer=lambda q, e: f"to {q}")
    assert main(["build", "--config", str(at)], m) == 0
    monkeypatch.setattr("sys.stdin", io.StringIO("fee?\n\nhours?\nquit\n"))
    assert main(["chat", "--config", str(at)], m) == 0
    out = capsys.readouterr().out
    assert "to fee?" in out and "to hours?" in out and "[kb] a.md" in out


def test_models_over_http(tmp_path):
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"choices": [{"message": {"content": "ya, one"}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    m = models.from_settings(config.Settings([], "", model={"base_url": f"http://127.0.0.1:{server.server_port}/v1/", "model": "m", "api_key": "k"}))
    assert m.verify("q", "t") == m.paraphrase("q", 2) == m.reformat("t") == m.answer("q", [{"file": "f", "knowledge_base": None, "text": "t"}]) == "ya, one"
    server.shutdown()
    assert {(p, a) for p, a, _ in asked} == {("/v1/chat/completions", "Bearer k")} and [b["temperature"] for _, _, b in asked] == [0, 0.3, 0, 0]
    assert models.from_settings(config.Settings([], "")).answer is None


def test_settings(monkeypatch, tmp_path):
    raw = {k: {} for k in config.NEEDED} | {"vectorstore_config": {"persist_directory": "i"}, "document_folders": "one", "llm_config": {"api_key": "${QUARRY_KEY}", "base_url": "${QUARRY_KEY}"}}
    with pytest.raises(config.SettingsError, match="QUARRY_KEY"):
        config.parsed(raw)
    monkeypatch.setenv("QUARRY_KEY", "k")
    got = config.parsed(raw)
    assert got.model == {"api_key": "k", "base_url": "${QUARRY_KEY}"} and got.folders == ["one"] and got.candidates == 15
    with pytest.raises(config.SettingsError, match="chunking_config"):
        config.parsed({k: v for k, v in raw.items() if k != "chunking_config"})


def test_command_line_pieces():
    assert list(questions(["a\n", "  \n", "QUIT\n", "b\n"])) == ["a"]
    assert rendered("q", Checked([], None)) == "NOT FOUND: q"
    assert "FOUND in 1 file(s)" in rendered("q", Checked([{"file": "f", "knowledge_base": "k", "score": 0.5, "chunk_count": 1, "text": ""}], "so"))
