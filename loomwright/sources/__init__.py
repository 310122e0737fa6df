"""Where tables live and what the catalog knows of them."""
