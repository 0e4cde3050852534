from .roles import roles, register_roles, register_tables, with_roles, role_df  # noqa: F401
