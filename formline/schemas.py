"""Fixed schemas of the domain tables.

Play time is stored as whole seconds (``min_seconds``) instead of an interval,
so that the files can be exchanged with any Parquet reader.
"""

from __future__ import annotations

_COUNTS = "pts int, reb int, ast int, stl int, blk int, tov int, pf int"
_SHOTS = "fgm int, fga int, fg3m int, fg3a int, ftm int, fta int"
_PCTS = "fg_pct double, fg3_pct double, ft_pct double"

# Schemas in DDL form, as `spark.read.schema` takes them.
TABLES: dict[str, str] = {
    "teams": (
        "id bigint, full_name string, abbreviation string, nickname string, city string, "
        "state string, year_founded int, conference string, division string"
    ),
    "players": (
        "id bigint, full_name string, birthdate date, height string, weight int, position string, "
        "country string, jersey string, school string, is_active boolean, season_exp int, "
        "from_year int, to_year int, draft_year int, draft_round int, draft_number int, "
        "bio_synced boolean, awards_synced boolean, last_award_sync timestamp"
    ),
    "games": (
        "id string, date date, season string, rs boolean, ist boolean, po boolean, pi boolean, "
        "status int, home_team_id bigint, away_team_id bigint, home_score int, away_score int, "
        "winner_team_id bigint, quarter_scores struct<home:array<int>,away:array<int>>"
    ),
    "player_game_stats": (
        f"id bigint, game_id string, player_id bigint, team_id bigint, min_seconds bigint, {_COUNTS}, "
        f"plus_minus double, {_SHOTS}, {_PCTS}"
    ),
    "player_team_seasons": (
        f"player_id bigint, team_id bigint, season string, type string, start_date date, end_date date, "
        f"games_played bigint, {_COUNTS}, {_SHOTS}, plus_minus double, min_seconds bigint, is_detailed boolean"
    ),
    "team_game_stats": (
        "game_id string, team_id bigint, total_pts bigint, total_reb bigint, total_ast bigint, "
        "total_stl bigint, total_blk bigint, total_tov bigint, total_pf bigint, avg_plus_minus double, "
        "total_fgm bigint, total_fga bigint, fg_pct double, total_fg3m bigint, total_fg3a bigint, "
        "fg3_pct double, total_ftm bigint, total_fta bigint, ft_pct double"
    ),
    "player_awards": (
        "player_id bigint, season string, award_type string, award_name string, description string"
    ),
    "league_outliers": (
        "stat_id bigint, reconstruction_error double, percentile double, "
        "contributions map<string,double>, is_outlier boolean, model_version string"
    ),
    "player_outliers": (
        "stat_id bigint, z_scores map<string,double>, max_z_score double, outlier_type string, "
        "outlier_features array<struct<feature:string,z_score:double,sentiment:string,val:double,avg:double>>, "
        "games_in_sample bigint"
    ),
    "player_trends": (
        "player_id bigint, window_type string, reference_date date, z_scores map<string,double>, "
        "max_z_score double, outlier_type string, comparison map<string,"
        "struct<current_avg:double,baseline_avg:double,diff_pct:double,sentiment:string>>, "
        "games_in_window bigint, games_in_baseline bigint"
    ),
    "season_states": (
        "player_id bigint, season string, games_played bigint, first_game_date date, "
        "last_game_date date, accumulated map<string,double>"
    ),
    "streaks": (
        "player_id bigint, streak_type string, competition_type string, length bigint, "
        "is_active boolean, is_historical boolean, started_at date, ended_at date, "
        "first_game_id string, last_game_id string"
    ),
    "streak_records": (
        "streak_type string, competition_type string, player_id bigint, length bigint, "
        "started_at date, ended_at date, first_game_id string, last_game_id string"
    ),
    "checkpoints": "key string, value string, updated_at timestamp",
    "system_status": "task string, status string, progress int, updated_at timestamp",
    "log_entries": "ts timestamp, level string, module string, message string, traceback string",
}

# Child before parent, the order in which dependent tables are emptied.
PURGE_ORDER = [
    "player_outliers", "league_outliers", "player_trends", "season_states", "streaks",
    "streak_records", "player_awards", "player_team_seasons", "team_game_stats",
    "player_game_stats", "games", "players", "teams",
]

# Unique keys and parents, used by the validation operators.
UNIQUE_KEYS = {
    "teams": ["abbreviation"],
    "player_game_stats": ["game_id", "player_id"],
    "player_team_seasons": ["player_id", "team_id", "season", "type"],
    "team_game_stats": ["game_id", "team_id"],
    "player_awards": ["player_id", "season", "award_type", "award_name", "description"],
    "league_outliers": ["stat_id"],
    "player_outliers": ["stat_id"],
    "player_trends": ["player_id", "window_type", "reference_date"],
    "season_states": ["player_id", "season"],
    "streaks": ["player_id", "streak_type", "competition_type", "started_at"],
    "streak_records": ["streak_type", "competition_type"],
}

PARENTS = {
    "games": [("home_team_id", "teams", "id"), ("away_team_id", "teams", "id")],
    "player_game_stats": [
        ("game_id", "games", "id"), ("player_id", "players", "id"), ("team_id", "teams", "id"),
    ],
    "player_awards": [("player_id", "players", "id")],
}
