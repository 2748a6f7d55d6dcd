import json

import pytest

from foldwright.cli import main
from foldwright.lang.ast import show
from foldwright.operators.catalog import CATALOG
from foldwright.sources.programs import write_program
from foldwright.sources.pyagg import Aggregator, when
from foldwright.sources.scala import read_scala, ScalaError
from foldwright.synth.derive import derive_merge

SCALA = """
import org.apache.spark.sql.expressions.Aggregator
case class In(key: String, price: Double)  // a row
case class Buf(counts: Map[String, Long], best: Double = 0.0, seen: Boolean = false)
object Prices extends Aggregator[In, Buf, String] {
  def zero: Buf = Buf(Map.empty[String, Long])
  def reduce(b: Buf, in: In): Buf = {
    val n = b.counts.getOrElse(in.key, 0L) + 1L
    val ok = in.price >= 1.5 &&
      !(in.key == "none")
    Buf(
      best = if (ok && in.price > b.best) in.price else b.best,
      counts = b.counts + (in.key -> n),
      seen = true
    )
  }
  def merge(a: Buf, b: Buf): Buf = ???
  def finish(b: Buf): String = b.toString
}
"""


def test_scala():
    f = read_scala(SCALA.replace("ok && in.price > b.best", "in.price > b.best"))
    assert str(f.state) == "(map[str, num], num, bool)"
    assert [s.kind for s in derive_merge(f).shapes] == ["map_sum", "max", "or"]
    assert show(f.init) == "(empty_map, 0, false)"


@pytest.mark.parametrize("cut", ["extends Aggregator[In, Buf, String]", "def zero: Buf = Buf(Map.empty[String, Long])", "in.price >= 1.5"])
def test_scala_outside_the_subset(cut):
    with pytest.raises(ScalaError):
        read_scala(SCALA.replace(cut, "?" if "price" in cut else ""))


def test_scala_default_is_kept():
    f = read_scala(SCALA.replace("getOrElse(in.key, 0L)", "getOrElse(in.key, 5L)"))
    assert "contains_key" in show(f.acc)


def test_python_class():
    class Bids(Aggregator):
        state, row = "(num, num, num, set[num])", "(num, num)"

        def zero(self):
            return 0, 0, float("-inf"), set()

        def reduce(self, s, x):
            return s[0] + when(x[1] > 3, x[0], 0), s[1] + 1, when(x[0] > s[2], x[0], s[2]), s[3].add(x[1])

    d = derive_merge(Bids().fold())
    assert d.status == "merged" and [s.kind for s in d.shapes] == ["sum", "sum", "max", "set_add"]
    with pytest.raises(TypeError):
        bool(Bids().fold() and when(1, 2, 3))


def test_command_line(tmp_path, capsys):
    program = tmp_path / "counter.json"
    program.write_text(write_program(CATALOG["counter"]))
    assert main(["--json", str(program)]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["status"] == "Success" and out["normalizer"]["Ok"].startswith("(l: map[num, num])")
    assert set(out) == {"status", "normalizer", "input_stats", "input_ast_size", "normalizer_ast_size", "elapsed"}
    (tmp_path / "results").mkdir()
    (tmp_path / "results/a.json").write_text(json.dumps(out))
    assert main(["--report", str(tmp_path / "results")]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == {"Success": 1}
    scala = tmp_path / "p.scala"
    scala.write_text(SCALA)
    assert main(["--scala", str(scala), "--to", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["init"]["type"] == "Tuple"
    program.write_text(write_program(CATALOG["ohlc"]))
    assert main(["--json", str(program), "--mode", "no-lift"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] in ("Refuted", "Ordered")
    assert main(["--json", str(tmp_path / "none")]) == 1


def test_bounds_of_boxed_integers():
    from foldwright.lang.ast import show
    from foldwright.sources.scala import read_scala

    f = read_scala("""case class In(v: Integer)
case class Buf(lo: Long, hi: Long)
class Bounds extends Aggregator[In, Buf, Long] {
  def zero: Buf = Buf(Integer.MAX_VALUE.toLong, Integer.MIN_VALUE.toLong)
  def reduce(b: Buf, a: In): Buf = Buf(if (a.v < b.lo) a.v else b.lo, if (a.v > b.hi) a.v else b.hi)
}""")
    assert show(f.init) == "(_mx, _mn)"


def test_batch_and_comparison(tmp_path):
    import json

    from foldwright.cli import batch, compare
    from foldwright.operators.catalog import CATALOG
    from foldwright.sources.programs import write_program

    (tmp_path / "in").mkdir()
    for name in ("average", "clickstream", "bid_stats"):
        (tmp_path / "in" / f"{name}.json").write_text(write_program(CATALOG[name]))
    (tmp_path / "in" / "broken.scala").write_text("class X")
    assert batch(str(tmp_path / "in"), str(tmp_path / "full"), jobs=2) == {"Success": 2, "Lifted": 1, "Error": 1}
    batch(str(tmp_path / "in"), str(tmp_path / "less"), "no-lift")
    found = compare([str(tmp_path / "full"), str(tmp_path / "less")])
    assert found[str(tmp_path / "less")]["solved_less"] == ["clickstream"]
    assert found[str(tmp_path / "full")]["quantiles"]["input_ast_size"]["1.0"] >= 1
    assert json.loads((tmp_path / "less" / "clickstream.json").read_text())["status"] in ("Refuted", "Ordered")
