from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from formline.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", shuffle_partitions=4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def line(i, player, day, pts=0, seconds=1800, season="2023-24", **kw):
    """A stat line with every column the detectors read."""
    base = dict(
        id=i, game_id=i, player_id=player, game_date=day, season=season, min_seconds=seconds, pts=pts, ast=0, reb=0, stl=0, blk=0,
        tov=0, pf=0, fga=0, fgm=0, fta=0, ftm=0, fg3a=0, fg3m=0, fg_pct=0.0, fg3_pct=0.0, ft_pct=0.0, plus_minus=0.0,
        rs=True, po=False, ist=False, team_id=1,
    )
    return base | kw


LINE_SCHEMA = (
    "id bigint, game_id bigint, player_id bigint, game_date date, season string, min_seconds bigint, pts bigint, ast bigint, reb bigint, "
    "stl bigint, blk bigint, tov bigint, pf bigint, fga bigint, fgm bigint, fta bigint, ftm bigint, fg3a bigint, fg3m bigint, "
    "fg_pct double, fg3_pct double, ft_pct double, plus_minus double, rs boolean, po boolean, ist boolean, team_id bigint"
)


def lines_df(spark, items):
    return spark.createDataFrame(items, LINE_SCHEMA)
