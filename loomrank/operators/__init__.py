"""Part of loomrank."""
