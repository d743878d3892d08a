"""DuckDB SQL that answers the registered queries independently of Spark."""
