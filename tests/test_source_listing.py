"""What the driver holds of a listing: files one after the other, packed by task."""

import os
import pickle
import tracemalloc

from pyarrow import fs

from reelbase.plans import queries as Q
from reelbase.sources import media_files as M


def test_a_long_listing_is_held_packed():
    many = 200_000
    told = lambda: ((f"file:/data/media/films/{k * 7919 % many:07}.wav", 56 + k % 200, 1_764_500_000_000_000_000 + k * 997_003) for k in range(many))
    tracemalloc.start()
    tasks = M.plan(told())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 << 20 and sum(len(pickle.dumps(t)) for t in tasks) < 20 * many, most
    assert sorted(f for t in tasks for f in t.files) == sorted(told())
    assert all(t.files == sorted(t.files) and len(t.files) <= M.MANY for t in tasks)


def test_packed_files_come_back_as_they_were():
    files = [("file:/a/b\nc.gif", 0, 0), ("file:/a/é \udcff.gif", 2**40, 2**62), ("file:/a/", 1, -1)]
    assert pickle.loads(pickle.dumps(M.Files(files))).files == sorted(files) and M.Files([]).files == []


def test_the_listing_is_arrow_s_without_its_list(tmp_path, monkeypatch):
    for name in ("a.gif", "x/b.gif", "x/y/c.wav", "x/_half/d.gif", ".hidden/e.gif", "x/.f.gif", "_g.gif", "z.gif/h.gif"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "empty").mkdir()
    (tmp_path / "gone.gif").symlink_to(tmp_path / "nowhere")
    (tmp_path / "link.gif").symlink_to(tmp_path / "a.gif")
    (tmp_path / "linked").symlink_to(tmp_path / "x" / "y")
    os.mkfifo(tmp_path / "pipe.gif")
    root = str(tmp_path)
    found = fs.LocalFileSystem().get_file_info(fs.FileSelector(root, recursive=True))
    wanted = sorted((f"file:{f.path}", f.size, f.mtime_ns) for f in found if f.is_file and not any(x[0] in "_." for x in f.path[len(root) + 1 :].split("/")))
    monkeypatch.setattr(fs, "FileSelector", None)
    assert [x[0][len(root) + 6 :] for x in wanted] == ["a.gif", "link.gif", "linked/c.wav", "x/b.gif", "x/y/c.wav", "z.gif/h.gif"]
    for path in (root, root + "/", "file://" + root):
        assert sorted(M.listing(path)) == wanted
    assert list(M.listing(root + "/_g.gif")) == [(f"file:{root}/_g.gif", 6, os.stat(root + "/_g.gif").st_mtime_ns)]


def test_written_files_are_spread_over_folders(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "shared_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(Q, "once", lambda files: files)
    monkeypatch.setattr(Q.R, "media", lambda files, kinds: files.selectExpr("path", "'' mime", "0 samplerate", "length", "'' status"))
    keys = {r.p_partkey for r in Q.source_files(spark, sf).collect()}
    names = [(top, x) for top, _, xs in os.walk(tmp_path / "files") for x in xs]
    parts = {r[0] for r in Q.X.table(spark, sf, "part").select("p_partkey").collect()}
    assert sorted(x for _, x in names) == sorted(f"{k}.{s}" for k in parts for s in ("gif", "wav")) and keys <= parts
    assert all(os.path.basename(top) == f"d{x.split('.')[0][:-3]}" for top, x in names)
