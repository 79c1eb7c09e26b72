import io
import tarfile
import zipfile

from evalweave.sources import archives


def test_members(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name, data in (("x/1.wav", b"one"), ("x/1.json", b"{}"), ("x/1.json", b"again"), ("../2.wav", b"two"), ("3.wav", b"long one"), ("4.txt", b"")):
            m = tarfile.TarInfo(name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))
        m = tarfile.TarInfo("5.wav")
        m.type, m.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(m)
    with zipfile.ZipFile(tmp_path / "b.tar", "w") as z:
        z.writestr("d/7.wav", b"zip")
        z.writestr("d/7.json", b"{}")
    (tmp_path / "c.tar").write_bytes(b"neither")
    found = archives.members(spark, str(tmp_path), "*.tar", most_bytes=5)
    rows = {(r["archive"][-5], r["member"], r["fault"]) for r in found.collect()}
    assert {r for r in rows if r[0] == "a"} == {("a", "x/1.wav", None), ("a", "x/1.json", None), ("a", "x/1.json", "repeated"), ("a", "../2.wav", "path"), ("a", "3.wav", "size"), ("a", "4.txt", None), ("a", "5.wav", "link")}
    assert [r for r in rows if r[0] == "c"][0][2] and len(rows) == 10
    assert bytes(found.filter("member = 'd/7.wav'").first()["content"]) == b"zip"
    assert sorted(r["stem"] for r in archives.complete(found, [".wav", ".json"]).collect()) == ["1", "7"]
    assert {r["member"] for r in archives.members(spark, str(tmp_path), "b.tar", ".wav").collect()} == {"d/7.wav"}
