from pathlib import Path


def duck(sql, folder, columns):
    """Rows of a DuckDB query over the Parquet tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
