"""The service and its client over a live loopback server."""

import io

import pytest

from lontar.service.cli import Client, run
from lontar.service.server import Limits, Service, hash_password, serve


def test_service(spark, tmp_path):
    users = {"ana": (hash_password("secret"), "admin"), "budi": (hash_password("other"), "reader")}
    service = Service(spark, str(tmp_path), users, Limits(tries=2))
    server = serve(service)
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        with pytest.raises(RuntimeError, match="failed"):
            Client(url, "ana", "wrong")
        ana = Client(url, "ana", "secret")
        out = io.StringIO()
        script = ["Buat 'toko' -: Buat Tabel 'A' Isi 'No & Harga'\n", "Dengan 'No = I(P) & Harga = U' -:\n", "Isi Tabel 'A' '1 & 2.50' '2 & 1' -:\n", "Pilih 'No & Harga / 3' Dari 'A' -:\n", ".tables\n", "Salah -:\n"]
        assert run(ana, script, out) == 1
        assert "5/6" in out.getvalue() and "| A " in out.getvalue() and "Error:" in out.getvalue()
        budi = Client(url, "budi", "other")
        budi.query("Pilih 'toko' -:")
        assert budi.query("Pilih 'Harga' Dari 'A' Dengan 'No = 1' -:").rows == [["2.50"]]
        with pytest.raises(RuntimeError, match="reader"):
            budi.query("Baris_Rmv 'A' -:")
        budi.close()
        with pytest.raises(RuntimeError, match="no session"):
            budi.query("Tampilkan 'A' -:")
        for _ in range(2):
            with pytest.raises(RuntimeError):
                Client(url, "budi", "x")
        with pytest.raises(RuntimeError, match="locked"):
            Client(url, "budi", "other")
    finally:
        server.shutdown()
