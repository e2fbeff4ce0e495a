"""Writers: mapper XML, SQL layout, reports."""
