"""Small event records."""

from postloom.schemas import FOLLOW, POST, REPOST


def post(author, rkey, text="a text that is long enough", langs=("en",), cid=None, **extra):
    return {
        "action": "create",
        "type": POST,
        "author": author,
        "createdAt": "2025-01-01T10:00:00Z",
        "uri": f"at://{author}/app.bsky.feed.post/{rkey}",
        "cid": cid or f"cid-{rkey}",
        "text": text,
        "langs": None if langs is None else list(langs),
        **extra,
    }


def repost(author, of, cid=None, at="2025-01-01T11:00:00Z", **extra):
    return {
        "action": "create",
        "type": REPOST,
        "author": author,
        "createdAt": at,
        "uri": f"at://{author}/app.bsky.feed.repost/1",
        "cid": "r1",
        "subject": {"uri": of["uri"], "cid": cid or of["cid"]},
        **extra,
    }


def follow(author, target):
    return {
        "action": "create",
        "type": FOLLOW,
        "author": author,
        "createdAt": "2025-01-01T12:00:00Z",
        "uri": f"at://{author}/app.bsky.graph.follow/1",
        "cid": "f1",
        "subject": target,
    }


def frame(spark, records, date="2025-01-01"):
    from postloom.schemas import FIREHOSE

    rows = []
    for r in records:
        rows.append(
            tuple(
                r.get(f.name, date if f.name == "ingest_date" else None) for f in FIREHOSE.fields
            )
        )
    return spark.createDataFrame(rows, FIREHOSE)
