"""The command line, from files to files."""

import json

import numpy as np
import pytest

from lattice.__main__ import PROGRAMS, main, parser


def written(folder, kind="<f8"):
    return np.concatenate([np.fromfile(p, kind) for p in sorted(folder.glob("part-*"))])


def lines(folder):
    return sorted(x for p in folder.glob("part-*") for x in p.read_text().splitlines())


@pytest.fixture
def matrix(tmp_path):
    a = np.arange(64.0).reshape(8, 8) % 11
    a.tofile(tmp_path / "a.bin")
    return a


def test_block_gemm(spark, tmp_path, matrix):
    main(["block_gemm", str(tmp_path / "a.bin"), "8", "4", str(tmp_path / "out")], spark)
    assert (written(tmp_path / "out").reshape(8, 8) == matrix @ matrix).all()


def test_points(spark, tmp_path, matrix):
    path = str(tmp_path / "a.bin")
    main(["kmeans", path, "8", "8", "2", str(tmp_path / "means")], spark)
    assert len(lines(tmp_path / "means" / "cluster_centres")) == 2
    assert [x.split()[0] for x in lines(tmp_path / "means" / "membership")] == [str(n) for n in range(8)]
    main(["knn", path, path, "8", "8", "1", str(tmp_path / "near")], spark)
    assert written(tmp_path / "near" / "knn_index", "<i8").tolist() == list(range(8))
    assert written(tmp_path / "near" / "knn_dist").tolist() == [0.0] * 8


def test_graphs(spark, tmp_path):
    w = np.zeros((4, 4), "<i8")
    w[0, 1], w[1, 2], w[0, 2] = 2, 3, 9
    w.tofile(tmp_path / "g.bin")
    for name in ("bfs", "bellmanford", "pagerank"):
        main([name, str(tmp_path / "g.bin"), "4", str(tmp_path / name)], spark)
    assert lines(tmp_path / "bfs") == ["0) cost:0", "1) cost:1", "2) cost:1", "3) cost:-1"]
    assert lines(tmp_path / "bellmanford") == ["0 0", "1 2", "2 5", "3 2147483647"]
    assert len(lines(tmp_path / "pagerank")) == 4
    (tmp_path / "g.txt").write_text("3 2\n2\n3\n\n")
    main(["bfs", str(tmp_path / "g.txt"), "3", str(tmp_path / "far")], spark)
    assert lines(tmp_path / "far") == ["0) cost:0", "1) cost:1", "2) cost:2"]


def test_stencils(spark, tmp_path, matrix):
    path = str(tmp_path / "a.bin")
    main(["convolution", path, "8", "4", str(tmp_path / "conv"), "--taps", "0", "1", "0"], spark)
    assert (written(tmp_path / "conv").reshape(8, 8) == matrix).all()
    main(["hotspot", path, path, "8", "4", str(tmp_path / "heat"), "--halo", "global"], spark)
    assert written(tmp_path / "heat").shape == (64,)


def test_tensors_and_comparison(spark, tmp_path):
    cube, m = np.arange(64.0).reshape(4, 4, 4), np.arange(8.0).reshape(2, 4)
    for name, x in (("c", cube), ("v", m[1]), ("m", m)):
        x.tofile(tmp_path / f"{name}.bin")
    at = {n: str(tmp_path / f"{n}.bin") for n in "cvm"}
    main(["ttv", at["c"], at["v"], "4", str(tmp_path / "ttv")], spark)
    assert (written(tmp_path / "ttv").reshape(4, 4) == cube @ m[1]).all()
    main(["tc", at["c"], at["m"], "4", "2", str(tmp_path / "tc")], spark)
    assert (written(tmp_path / "tc").reshape(2, 4, 4) == np.einsum("nmk,pk->pnm", cube, m)).all()
    (cube[0] + np.eye(4)).tofile(tmp_path / "x.bin")
    cube[0].tofile(tmp_path / "y.bin")
    main(["compare", str(tmp_path / "x.bin"), str(tmp_path / "y.bin"), "4", "2", str(tmp_path / "cmp")], spark)
    assert lines(tmp_path / "cmp") == ["0 0 2", "0 1 0", "1 0 0", "1 1 2"]


def test_trace(spark, tmp_path):
    (tmp_path / "run").mkdir()
    np.array([1, 5, 9], "<u8").tofile(tmp_path / "run" / "load_ts.bin")
    main(["trace", str(tmp_path / "t.json"), str(tmp_path / "run")], spark)
    assert [e["ts"] for e in json.load(open(tmp_path / "t.json"))] == [5, 9]


def test_every_program_parses():
    for run, (places, options) in PROGRAMS.items():
        more = ["--taps", "1", "2", "1"] if "taps" in options else []
        assert parser().parse_args([run.__name__, "in", *["1"] * len(places.split()), "out", *more]).output == "out"
