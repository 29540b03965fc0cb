"""DataFrame operators: each takes DataFrames (and column names) and returns a
DataFrame whose plan Catalyst can optimise end to end."""
