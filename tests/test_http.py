"""The JSON front end, by its routes and once through a socket."""

import json
from threading import Thread
from urllib.request import urlopen

from textmill.plans.engine import Engine
from textmill.plans.http import Api, serve


def test_routes(spark):
    engine = Engine(spark)
    api = Api(engine)
    records = [{"id": 1, "title": "red plate"}, {"id": 2, "title": "blue ring"}]
    assert api.handle("POST", "/api/index/create?name=things&id=id", json.dumps(records))[0] == 200
    assert api.handle("GET", "/api/indexes") == (200, {"indexes": ["things"]})
    status, found = api.handle("GET", "/api/search/things?q=plate&search_type=exact")
    assert status == 200 and found["total"] == 1 and found["items"][0]["id"] == 1
    assert api.handle("GET", "/api/index/things/data?value=RING")[1]["total"] == 1
    assert api.handle("POST", "/api/index/things/document", '{"id": 3, "title": "green ring"}')[0] == 200
    assert api.handle("PUT", "/api/index/things/document/0", '{"title": "old plate"}')[0] == 200
    assert api.handle("GET", "/api/index/things/document/0")[1]["title"] == "old plate"
    assert api.handle("DELETE", "/api/index/things/document/1")[0] == 200
    assert api.handle("GET", "/api/index/things/data")[1]["total"] == 2
    assert api.handle("GET", "/api/metrics")[1]["metrics"][0]["documents"] == 2
    assert api.handle("GET", "/api/index/things/document/9")[0] == 404
    assert api.handle("GET", "/api/search/other?q=x")[0] == 404
    assert api.handle("GET", "/api/search/things")[0] == 400
    assert api.handle("POST", "/api/index/things/document", "[1]")[0] == 400
    server = serve(engine, 0)
    Thread(target=server.serve_forever, daemon=True).start()
    with urlopen(f"http://127.0.0.1:{server.server_address[1]}/api/indexes") as answer:
        assert json.load(answer) == {"indexes": ["things"]}
    server.shutdown()
    assert api.handle("DELETE", "/api/index/things")[0] == 200
    assert api.handle("DELETE", "/api/index/things")[0] == 404
