"""Command line: python -m cadenza.cli {ingest,silver,gold,enrich,enriched} ..."""

from __future__ import annotations

import argparse
import json
import sys
import urllib.error
import urllib.parse
import urllib.request

from .plans import enriched, gold, ingest, pipeline
from .session import build_session
from .sources import config
from .sources.http import EntityProvider, PagedSource, RateLimiter, TagProvider
from .storage import release


class _Answer:
    def __init__(self, status: int, body: bytes) -> None:
        self.status_code, self.text = status, body.decode("utf-8", "replace")

    def json(self):
        return json.loads(self.text)


def urllib_transport(url: str, params: dict, headers: dict, timeout: float) -> _Answer:
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return _Answer(r.status, r.read())
    except urllib.error.HTTPError as e:
        return _Answer(e.code, e.read())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cadenza", description=__doc__)
    p.add_argument("--data", default="data", help="folder of all tables")
    sub = p.add_subparsers(dest="step", required=True)
    a = sub.add_parser("ingest", help="land pages of the paged source")
    a.add_argument("--backfill", action="store_true")
    a.add_argument("--resume", action="store_true", help="continue the latest backfill; needs --backfill")
    a.add_argument("--max-pages", type=int)
    a.add_argument("--endpoint", required=True)
    a.add_argument("--method", default="user.getRecentTracks")
    a = sub.add_parser("silver", help="completed runs to events")
    a.add_argument("--full", action="store_true")
    a.add_argument("--profile", action="store_true")
    a = sub.add_parser("gold", help="activity marts")
    a.add_argument("--full", action="store_true", help="marts are always built anew; prints the profile")
    a.add_argument("--profile", action="store_true")
    a.add_argument("--analytics", help="config with the era boundary")
    a = sub.add_parser("enrich", help="artists and tags from providers or the cache")
    a.add_argument("--limit", type=int)
    a.add_argument("--from-cache", action="store_true")
    a.add_argument("--profile", action="store_true")
    a.add_argument("--resume", action="store_true", help="rows that are there are always kept")
    a.add_argument("--config", default="config/enrichment.json")
    a.add_argument("--entity-endpoint")
    a.add_argument("--tag-endpoint")
    a = sub.add_parser("enriched", help="enriched marts")
    a.add_argument("--profile", action="store_true")
    a.add_argument("--taxonomy", required=True)
    a.add_argument("--periods", required=True)
    return p


def main(argv: list[str] | None = None, transport=urllib_transport) -> dict:
    p = parser()
    o = p.parse_args(argv)
    if o.step == "ingest" and o.resume and not o.backfill:
        p.error("--resume needs --backfill")
    if o.step == "ingest" and o.max_pages is not None and o.max_pages < 1:
        p.error("--max-pages must be at least 1")
    spark = build_session()
    d = o.data.rstrip("/")
    if o.step == "ingest":
        s = config.settings()
        out = ingest.ingest(spark, PagedSource(transport, o.endpoint, o.method, s.user, s.api_key), f"{d}/bronze", o.backfill, o.resume, o.max_pages)
    elif o.step == "silver":
        out = pipeline.transform(spark, f"{d}/bronze", f"{d}/silver", o.full)
    elif o.step == "gold":
        out = pipeline.build_gold(spark, f"{d}/silver/events", f"{d}/gold", config.boundary(o.analytics) if o.analytics else gold.BOUNDARY)
    elif o.step == "enrich":
        c = config.enrichment(o.config)
        ent = EntityProvider(transport, o.entity_endpoint, c["agent"], RateLimiter(c["entity_interval_seconds"])) if o.entity_endpoint else None
        tag = TagProvider(transport, o.tag_endpoint, config.settings().api_key, RateLimiter(c["tag_interval_seconds"])) if o.tag_endpoint else None
        out = pipeline.enrich_artists(spark, f"{d}/silver/events", f"{d}/enrichment/raw", f"{d}/enrichment/normalized", ent, tag, o.limit, o.from_cache, tag_limit=c["artist_tag_limit"])
    else:
        c = config.read_config(o.taxonomy)
        out = pipeline.build_enriched(
            spark, f"{d}/silver/events", f"{d}/enrichment/normalized/artists", f"{d}/enrichment/normalized/artist_tags", enriched.taxonomy_table(spark, c),
            config.periods(o.periods), f"{d}/gold_enriched", most_tags=c.get("max_tags_per_artist", enriched.MAX_TAGS),
        )
    release(spark)
    if getattr(o, "profile", False) or getattr(o, "full", False):
        print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
